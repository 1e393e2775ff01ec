"""Held-out rows of a larger table: bars well above what a constant answer gives."""

import pytest

from sievework.llm import entry

LARGE = "/root/testdata/sf0.1"


def held_out(spark, name, label):
    got = {r.doc_id: r for r in getattr(entry, name)(spark, LARGE).collect()}
    labels = [(r.doc_id, r[label]) for r in spark.read.parquet(f"{LARGE}/labels.parquet").collect() if r[label] is not None]
    return [(y, got[i].predicted, got[i].score) for i, y in labels if i in got and got[i].held_out]


@pytest.mark.parametrize("name,label,precision,recall", [("op1_quality", "quality", 0.98, 0.98), ("op4_toxicity", "toxic", 0.88, 0.75)])
def test_precision_and_recall(spark, name, label, precision, recall):
    rows = held_out(spark, name, label)
    assert len(rows) > 500 and {y for y, _, _ in rows} == {0, 1}
    both = sum(y and p for y, p, _ in rows)
    assert both / sum(p for _, p, _ in rows) >= precision and both / sum(y for y, _, _ in rows) >= recall
    # the other class too: of negatives few are taken
    assert sum(p and not y for y, p, _ in rows) / sum(not y for y, _, _ in rows) <= 0.05
    # scores order the rows: the area under the curve, equal scores as half
    pos, neg = ([s for y, _, s in rows if y == k] for k in (1, 0))
    area = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert area >= 0.9
