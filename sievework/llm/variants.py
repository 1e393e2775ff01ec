"""Spelling variants: words one edit apart, found by each word's distance-one automaton in compact tries of all words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, stored, tidy

#: Words and code points in a trie at most (about 12 bytes a code point), bytes of tries that are broadcast at once,
#: and words looked up in a task.
SHARD_WORDS, SHARD_CHARS, PASS_BYTES, TASK_WORDS = 1 << 19, 1 << 22, 64 << 20, 16_384

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(text: Column) -> Column:
    """Maximal runs of Latin letters; only A-Z are lower-cased."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit("([a-z\\u00C0-\\u00FF]+)"), F.lit(1))


def word_counts(docs: DataFrame, slip: int = 97, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n): the words of whole texts of at least least_length code points and least_count occurrences.

    Where the crc32 of `<doc_id>:<run>` is divisible by `slip`, the run's code point at crc32 modulo length is
    deleted.  A null text has no words, a null id is written as nothing; repeated rows count again; an empty
    table has no words; other columns are left out.  Occurrences are summed before the shuffle, so a
    frequent word is no hot key.
    """
    run, h = F.col("run"), F.col("h")
    at = F.pmod(h, F.length(run)).cast("int")
    flat = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"), F.explode(runs(F.col("text"))).alias("run"))
    hashed = flat.where(F.length(run) >= least_length).select(run, F.crc32(F.concat("i", F.lit(":"), run).cast("binary")).alias("h"))
    slipped = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    words = hashed.select(F.when(h % slip == 0, slipped).otherwise(run).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


class Trie:
    """Sorted words of code points below 256 in level order: a node's children are neighbours in `labels`."""

    def __init__(self, labels: bytes, first: np.ndarray, word: np.ndarray, n: np.ndarray):
        self.labels, self.first, self.word, self.n = labels, memoryview(first), memoryview(word), memoryview(n)
        held = np.zeros(len(labels), np.uint64)  # the labels of a node's children, modulo 64: which children need no look
        parents = np.flatnonzero(np.diff(first))
        if len(parents):
            held[parents] = np.bitwise_or.reduceat(np.uint64(1) << (np.frombuffer(labels, np.uint8)[1:] & 63).astype(np.uint64), first[parents] - 1)
        self.held = memoryview(held)

    @staticmethod
    def pack(words: list[bytes], n: list[int]) -> dict:
        """The parts of the trie of `words`, which are sorted and distinct."""
        data, size = np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        active, node = np.arange(len(words)), np.zeros(len(words), np.int64)  # words that reach this depth, and their nodes there
        labels, first, word, nodes, depth = [np.zeros(1, np.uint8)], [], [np.full(1, -1, np.int32)], 1, 0
        begin = 0  # number of the level's first node
        while len(active):
            on = size[active] > depth
            active, parent = active[on], node[on]
            label = data[start[active] + depth]
            new = np.ones(len(active), bool)
            new[1:] = (parent[1:] != parent[:-1]) | (label[1:] != label[:-1])
            first.append(nodes + np.searchsorted(parent[new], np.arange(begin, nodes)))
            begin, depth = nodes, depth + 1
            node = nodes + np.cumsum(new) - 1
            ends = np.full(int(new.sum()), -1, np.int32)
            done = size[active] == depth
            ends[node[done] - nodes] = active[done]
            labels.append(label[new])
            word.append(ends)
            nodes += len(ends)
        first.append(np.full(nodes - begin + 1, nodes))
        return {"labels": np.concatenate(labels).tobytes(), "first": np.concatenate(first).astype(np.int32).tobytes(), "word": np.concatenate(word).tobytes(), "n": np.array(n, np.int64).tobytes()}

    @staticmethod
    def unpack(parts) -> Trie:
        return Trie(parts["labels"], np.frombuffer(parts["first"], np.int32), np.frombuffer(parts["word"], np.int32), np.frombuffer(parts["n"], np.int64))

    def near(self, w: bytes) -> set[int]:
        """Numbers of the words one inserted, deleted or replaced code point from w, by a depth-first walk.

        The automaton's state is the place in w and whether the edit is spent.  While it is not, the walk
        stands on the path of w itself; once it is, one path is left, the rest of w.
        """
        labels, first, word, held, size = self.labels, self.first, self.word, self.held, len(w)
        find, out, stack = labels.find, set(), []
        v = i = 0
        while v >= 0:  # along w: at each node the places after one edit from which the rest of w may go on
            lo, hi = first[v], first[v + 1]
            if i == size:
                out.update(word[c] for c in range(lo, hi) if word[c] >= 0)
                break
            own = w[i]
            now = 1 << (own & 63)
            stack.append((v, i + 1))  # deleted
            if i + 1 < size:
                after = 1 << (w[i + 1] & 63)
                both = now | after
                for c in range(lo, hi):
                    if held[c] & both:
                        if held[c] & now:
                            stack.append((c, i))  # inserted
                        if held[c] & after and labels[c] != own:
                            stack.append((c, i + 1))  # replaced
            else:
                for c in range(lo, hi):
                    if held[c] & now:
                        stack.append((c, i))
                    if word[c] >= 0 and labels[c] != own:
                        out.add(word[c])
            v, i = find(own, lo, hi), i + 1
        while stack:
            v, i = stack.pop()
            while v >= 0 and i < size:
                v, i = find(w[i], first[v], first[v + 1]), i + 1
            if v >= 0 and word[v] >= 0:
                out.add(word[v])
        return out


def tries(words: DataFrame) -> DataFrame:
    """(shard, labels, first, word, n, words): compact tries of neighbouring words, of a bounded size each."""
    from sievework.operators.sampling import ordinal

    size = F.length("word")
    total = words.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("chars")).first()
    shards = max(1, -(-total.n // SHARD_WORDS), -(-(total.chars or 0) // SHARD_CHARS))
    each = -(-total.n // shards)
    placed = ordinal(words, [F.asc("word")], "at").select(F.floor((F.col("at") - 1) / max(each, 1)).alias("shard"), "word", F.col("n").alias("times"))

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        coded = sorted(zip((x.encode("latin-1") for x in pdf["word"]), pdf["times"]))
        spelt = [x for x, _ in coded]
        parts = Trie.pack(spelt, [n for _, n in coded])
        return pd.DataFrame([{"shard": key[0], **parts, "words": b"\n".join(spelt)}])

    return stored(placed.groupBy("shard").applyInPandas(build, "shard long, labels binary, first binary, word binary, n binary, words binary"), "tries")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form) of the words that have near words: their number, and the best one.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point; the best has the largest
    n, of ties the smallest in code-point order.  Tries are broadcast in passes of bounded bytes; each pass walks
    all words and sends back one row for each word that has a near one there; the passes are then reduced.
    """
    spark = words.sparkSession
    shards = tries(words)
    sizes = {r.shard: r.bytes for r in shards.select("shard", sum((F.length(c) for c in ("labels", "first", "word", "n", "words")), F.lit(0)).alias("bytes")).collect()}  # a row for each trie
    passes: list[list[int]] = []
    room = 0
    for k in sorted(sizes):
        if not passes or sizes[k] > room:
            passes.append([])
            room = PASS_BYTES
        passes[-1].append(k)
        room -= sizes[k]
    spread = words.select("word").repartition(max(1, -(-words.count() // TASK_WORDS)), "word")

    def walk(shared):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = [(Trie.unpack(p), p["words"].split(b"\n")) for p in shared.value]
            for pdf in batches:
                rows = []
                for spelt in pdf["word"]:
                    w, count, best = spelt.encode("latin-1"), 0, (1, b"")
                    for trie, names in held:
                        found = trie.near(w)
                        if found:
                            count += len(found)
                            best = min(best, min((-trie.n[k], names[k]) for k in found))
                    if count:
                        rows.append((spelt, count, -best[0], best[1].decode("latin-1")))
                yield pd.DataFrame(rows, columns=["word", "n_near", "form_n", "form"])
            tidy()

        return run

    out = None
    for group in passes:
        got = shards.where(F.col("shard").isin(group)).collect()  # PASS_BYTES, or one trie
        shared = spark.sparkContext.broadcast([r.asDict() for r in got])
        part = spread.mapInPandas(walk(shared), "word string, n_near long, form_n long, form string")
        part = part if len(passes) == 1 else stored(part, "near")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "word string, n_near long, form_n long, form string")
    if len(passes) == 1:
        return out
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form"))
    return out.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("form_n"), F.col("b.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: the last word that the forms lead to.

    Each round doubles the steps taken; a form has at least twice the occurrences, so a chain is as long as the logarithm
    of the largest count at most, and rounds are few.
    """
    step = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        longer = cut(step.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        step = longer.select("word", "root")
        if not longer.where("moved").limit(1).count():
            return step


def group_variants(docs: DataFrame, slip: int = 97, least_length: int = 5, least_count: int = 3, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word of `docs` and the spelling that stands for it.

    The form is the best near word (see neighbours) if it occurs at least `ratio` times as often, else null; the
    root is the last word that forms lead to, the word itself without one.  Null texts have no words; a word
    without near words has n_near 0; ties go to the smaller word; repeated rows count again; very long texts are
    whole; an empty table gives an empty result; other columns of any name are left out.
    """
    words = stored(word_counts(docs, slip, least_length, least_count), "words")
    near = cut(words.join(neighbours(words), "word", "left"))
    has = F.col("form_n") >= ratio * F.col("n")
    kept = near.select("word", F.when(has, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("form_n")).alias("form_n"))
    last = roots(kept.where("form IS NOT NULL"))
    return kept.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
