"""License scans: phrases, and an exact containment join of text blocks with license templates.

DataFrame expressions only.  A block is a line, or a window of words (windows overlap by half, so that every
passage of half a window lies whole in one, wrapped or not; each template looks at windows of twice its own
length, rounded up to a power of two), seen as its set of words.  The join is indexed:
tokens ordered by their frequency in the whole corpus, and an index of the templates' rarest ones, which
blocks meet by an equi-join.  Texts without any of these never leave their row.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Widely used license sentences, each with its label.
TEMPLATES = [
    ("apache-notice", "licensed under the apache license version 2 0"),
    ("mit-notice", "released under the mit license"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("cc-by-notice", "this work is licensed under a creative commons attribution 4 0 international license cc by"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("as-is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
]
#: Whole license texts and notices, each with its label.
WHOLE = [
    ("mit-license", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
in all copies or substantial portions of the Software. The Software is provided "as is", without warranty of any kind, express or
implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no
event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract,
tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software."""),
    ("bsd-license", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution. This software is provided by the
copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties
of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable
for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of
substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability,
whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software,
even if advised of the possibility of such damage."""),
    ("isc-license", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. The software is provided "as is" and the author
disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall
the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use,
data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or
performance of this software."""),
    ("zlib-license", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software
must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as
such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source
distribution."""),
    ("apache-header", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed
to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl-header", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public
License along with this program. If not, see http://www.gnu.org/licenses/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and
by any means."""),
]
#: A word and what may stand between words; A-Z count as letters, as patterns ignore their case.
WORD, GAP = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def phrase_pattern(phrase: str) -> str:
    return rf"(?<!{WORD})" + rf"{GAP}+".join(phrase.split()) + rf"(?!{WORD})"


def _any(patterns: list[str]) -> str:
    return "(?is)(?:" + "|".join(patterns) + ")"


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD + "+")).cast("long")


def with_phrases(docs: DataFrame, phrases: dict[str, str] | None = None, text: str = "text") -> DataFrame:
    """`docs` with __n_words, __n_base, __first, __last and __base (labels, sorted array) of the phrases."""
    phrases = PHRASES if phrases is None else phrases
    t = F.coalesce(F.col(text), F.lit(""))
    each = {p: phrase_pattern(p) for p in phrases}
    every = _any(list(each.values()))
    # the phrase test runs once for each text; all that follows only where it holds
    out = docs.withColumn("__n_words", n_words(t)).withColumn("__hit", t.rlike(every))
    only = lambda c, other: F.when(F.col("__hit"), c).otherwise(other)
    counts = [F.regexp_count(t, F.lit("(?is)" + p)) for p in each.values()]
    # the text before a place is taken by the pattern: positions that Java's patterns give count UTF-16 units
    before_first = F.regexp_extract(t, "(?is)^(.*?)" + every, 1)
    before_last = F.regexp_extract(t, "(?is)^(.*)" + every, 1)
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(t.rlike("(?is)" + p), F.lit(phrases[k])) for k, p in each.items()]))))
    return (
        out.withColumn("__n_base", only(sum(counts[1:], counts[0]).cast("long"), F.lit(0).cast("long")))
        .withColumn("__first", only(n_words(before_first), F.lit(None).cast("long")))
        .withColumn("__last", only(n_words(before_last), F.lit(None).cast("long")))
        .withColumn("__base", only(found, F.array().cast("array<string>")))
        .drop("__hit")
    )


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def plain(text: str) -> str:
    """A template's words, small, joined by spaces."""
    return " ".join(re.findall(WORD.replace("\\x40\\x5B", "\\x60") + "+", text.lower()))


def template_sets(templates: list[tuple[str, str]], windows: bool) -> list[tuple[str, list[str], int]]:
    """Each template's label, distinct words, and the size of its windows (0: lines).

    Templates of one label count for themselves.
    """
    return [(k, sorted(set(plain(t).split())), 1 << max(4, math.ceil(math.log2(2 * len(plain(t).split())))) if windows else 0) for k, t in templates]


def words_of(text: Column) -> Column:
    """All words in their order, A-Z in small letters."""
    return F.filter(F.split(F.translate(text, UPPER, UPPER.lower()), GAP + "+"), lambda w: w != "")


def blocks_of(text: Column, words: Column, scales: list[int]) -> Column:
    """Array of (scale, words): windows of so many words, each beginning in the middle of the one before; scale 0: the lines.

    `words` must be a column that holds words_of(text): an expression would be computed again for every window.
    """

    def of(scale: int) -> Column:
        block = lambda w: F.struct(F.lit(scale).alias("scale"), w.alias("words"))
        if not scale:
            return F.transform(F.split(text, "\n"), lambda line: block(words_of(line)))
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(scale // 2)), lambda i: block(F.slice(words, i, scale)))

    return F.concat(*[of(x) for x in scales])


def token_order(docs: DataFrame, templates: list[tuple[str, list[str], int]], text: str = "text") -> list[str]:
    """The templates' distinct words, the rarest in the whole corpus first (ties by the word itself).

    All words of all texts are counted that any template holds; the result has one row for each of these.
    """
    vocabulary = sorted({w for _, s, _ in templates for w in s})
    words = F.filter(words_of(F.col(text)), lambda w: w.isin(vocabulary))
    n = {r.w: r.n for r in docs.select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def containment(docs: DataFrame, templates: list[tuple[str, list[str], int]], order: list[str], threshold: float) -> DataFrame:
    """(i, h, shares): for each row with any, the templates (by number) a block of it holds, with their greatest share.

    i is the id, h the hash of the text.  A pair is a candidate if the block has one of a template's rarest
    |T| - need + 1 words (prefix filter, an equi-join with the index of these), need or more words of the
    vocabulary (length filter), and if from its first such word onwards both sides still have `need`
    (positional filter).  The overlap of the candidates is then counted.
    """
    spark = docs.sparkSession
    rank = {w: k for k, w in enumerate(order)}
    sets, scales = [sorted(rank[w] for w in s) for _, s, _ in templates], [x for *_, x in templates]
    need = [math.ceil(threshold * len(s) - 1e-9) for s in sets]
    index = [(r, scales[t], t, at) for t, (s, k) in enumerate(zip(sets, need)) for at, r in enumerate(s[: len(s) - k + 1])]
    # the templates are a fixed list, so these tables are small whatever the corpus
    vocabulary = F.broadcast(spark.createDataFrame(list(rank.items()), "w string, r int"))
    first_words = F.broadcast(spark.createDataFrame(index, "r int, scale int, t int, at int"))
    whole = F.broadcast(spark.createDataFrame([(t, k, len(s), s) for t, (s, k) in enumerate(zip(sets, need))], "t int, need int, size int, s array<int>"))
    rare = sorted({order[r] for r, *_ in index})
    # a look-up of each word in a hash set: a pattern with every rare word would try them all at every character
    some = docs.select(F.col("doc_id").alias("i"), F.xxhash64("text").alias("h"), "text", words_of(F.col("text")).alias("all")).where(F.exists("all", lambda w: w.isin(rare)))
    blocks = some.select("i", "h", F.posexplode(blocks_of(F.col("text"), F.col("all"), sorted(set(scales)))).alias("block", "x")).select("i", "h", "block", "x.*").where(F.exists("words", lambda w: w.isin(rare)))
    known = blocks.select("i", "h", "block", "scale", F.explode(F.array_distinct("words")).alias("w")).join(vocabulary, "w")
    ranks = known.groupBy("i", "h", "block", "scale").agg(F.array_sort(F.collect_set("r")).alias("b"))  # at most the vocabulary
    hits = ranks.select("i", "h", "block", "scale", "b", F.posexplode("b").alias("place", "r")).join(first_words, ["r", "scale"])
    first = hits.groupBy("i", "h", "block", "t").agg(F.min(F.struct("r", "at", "place", "b")).alias("m"))
    left = F.least(F.col("size") - F.col("m.at"), F.size("m.b") - F.col("m.place"))
    cand = first.join(whole, "t").where((F.size("m.b") >= F.col("need")) & (left >= F.col("need")))
    share = F.size(F.array_intersect("m.b", "s"))
    good = cand.select("i", "h", "t", "need", (share / F.col("size")).alias("share"), share.alias("n")).where("n >= need")
    best = good.groupBy("i", "h", "t").agg(F.max("share").alias("share"))
    return best.groupBy("i", "h").agg(F.collect_list(F.struct("t", "share")).alias("shares"))  # one for each template at most


def scan(docs: DataFrame, threshold: float = 0.8, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, windows: bool = False) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    base_labels come from the phrases, labels from these and from the templates of which a block (a line, or
    with `windows` a window of words) holds at least `threshold` of the words; score is the greatest such
    share, 1 where a phrase stands.  Templates are TEMPLATES and WHOLE unless given.  A null text is empty: no
    words, no labels, score 0.  Texts are whole, however long.  Repeated rows and null ids stay, other
    columns are left out, an empty table gives an empty result.
    """
    sets = template_sets(TEMPLATES + WHOLE if templates is None else templates, windows)
    src = docs.select("doc_id", "text")
    found = containment(src, sets, token_order(src.select("text"), sets), threshold)
    base = with_phrases(src, phrases).withColumn("h", F.xxhash64("text")).drop("text")
    shares = base.join(found.withColumnRenamed("h", "found_h"), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("found_h")), "left")
    names = F.array(*[F.lit(k) for k, *_ in sets])
    more = F.coalesce(F.transform("shares", lambda x: F.get(names, x["t"])), F.array().cast("array<string>"))
    return shares.select(
        "doc_id", F.col("__n_words").alias("n_words"), F.col("__n_base").alias("n_base"),
        F.col("__first").alias("first_word"), F.col("__last").alias("last_word"),
        F.array_join("__base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("__base", more)), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform("shares", lambda x: x["share"])), F.lit(0.0)), F.when(F.col("__n_base") > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def oracle_sql(threshold: float = 0.8) -> str:
    """DuckDB: places found in the word lists, and every window against every template, without filters."""
    gap = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
    words = lambda x: f"list_filter(string_split_regex({x}, '{gap}'), lambda x: x <> '')"
    places = {k: f"list_filter(range(0, len(w)), lambda i: w[i + 1 : i + {len(p.split())}] = {p.split()})" for k, p in enumerate(PHRASES)}
    labels = list(PHRASES.values())
    sets = template_sets(TEMPLATES + WHOLE, True)
    templates = ", ".join(f"('{k}', {t}, {x})" for k, t, x in sets)
    windows = " UNION ALL ".join(f"SELECT row_no, {x} AS scale, w, unnest(range(0, greatest(len(w), 1), {x // 2})) AS i FROM w" for x in sorted({x for *_, x in sets}))
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row_no, doc_id, {words(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} AS w FROM d),
p AS (SELECT row_no, doc_id, len(w) AS n_words, {", ".join(f"{x} AS p{k}" for k, x in places.items())} FROM w),
b AS (SELECT *, list_sort(flatten([{", ".join(f"p{k}" for k in places)}])) AS spots, list_sort(list_distinct(flatten([{", ".join(f"CASE WHEN len(p{k}) > 0 THEN ['{labels[k]}'] ELSE [] END" for k in places)}]))) AS base FROM p),
t(label, toks, scale) AS (VALUES {templates}),
l AS ({windows}),
s AS (SELECT row_no, scale, list_distinct(w[i + 1 : i + scale]) AS ws FROM l),
m AS (SELECT row_no, label, max(len(list_intersect(ws, toks)) / len(toks)::DOUBLE) AS share FROM s JOIN t USING (scale) WHERE len(list_intersect(ws, toks)) >= ceil({threshold} * len(toks) - 1e-9) GROUP BY ALL),
g AS (SELECT row_no, list(label) AS more, max(share) AS share FROM m GROUP BY row_no)
SELECT doc_id, n_words::BIGINT AS n_words, len(spots)::BIGINT AS n_base, spots[1]::BIGINT AS first_word, spots[-1]::BIGINT AS last_word,
  array_to_string(base, ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels,
  greatest(coalesce(share, 0), CASE WHEN len(spots) > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM b LEFT JOIN g USING (row_no)
"""
