import random

import pytest

sp = pytest.importorskip("sentencepiece")
P = pytest.importorskip("public_tokenizers")

from sievework.llm import spm  # noqa: E402

PATH = P.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", " a", "a  b   c", "    x", "a" * 3000, "ab" * 700, "aba" * 500, " " * 50, "x" + " " * 40 + "y", "\x00a\x00", " \n \t", "é𝄞日本語", "▁", "a▁b", "▁▁ x", "<s> </s> <unk> <0x41>", " ⁇ "]


def test_same_as_library():
    rnd = random.Random(5)
    texts = ODD + ["".join(rnd.choice("abcdeinot ersthéß▁ .,  ") for _ in range(rnd.randint(1, 80))) for _ in range(1500)] + ["".join(rnd.choice("abhetinors") for _ in range(rnd.randint(1, 300))) for _ in range(200)]
    lib, model = sp.SentencePieceProcessor(model_file=PATH), spm.load(PATH)
    for mine, ref, text in zip(spm.encode_block(model, texts), lib.encode(texts, add_bos=True, add_eos=True), texts, strict=True):
        assert mine.tolist() == ref, text[:50]
        assert spm.decode(model, mine) == lib.decode(ref)


def test_operator_rows(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, "y"), (2, "", None), (3, "long " * 30000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = spm.encode_documents(df, PATH, block_chars=1000).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in out) == sorted((r[0] or 0, r[1] or "") for r in rows)
    assert spm.encode_documents(df.limit(0), PATH).count() == 0
