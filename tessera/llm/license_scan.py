"""Operator 3: license scan by diagonal voting, in DataFrame functions only.

Templates are the base phrases (k = 2 words a gram) and passages of well-known notices and licenses (k = 3), from
one sentence to a whole text. All rolling word k-gram hashes of a document are joined with the template
positions; a hit votes for the diagonal document position - template position. Votes are aggregated by diagonal,
diagonals of one template that lie within ``GAP`` are merged (a few words put in or left out move the
rest to a neighbouring diagonal), and a merged span is verified on words: the document's own words of the span
are fetched again and their grams compared with the template's as text. A base phrase needs every gram on one diagonal;
a passage needs ``COVER`` of its words to stand in grams found within a span of bounded length.

Scale: the template table is fixed and some hundred rows, so it is broadcast; only hits are shuffled, and
only documents with spans meet them again, which a bit filter chooses.

Defined results: null texts are empty and have no words; rows repeating id and text get equal results;
rows repeating an id with another text are scanned by themselves, null ids too; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import sieve
from tessera.llm.workspace import Workspace

#: Base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Passages of published notices and licenses, in the words of the scan.
PASSAGES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this work is licensed under a creative commons attribution", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    (
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind "
        "express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be "
        "liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "mit",
    ),
    (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or "
        "implied see the license for the specific language governing permissions and limitations under the license",
        "apache",
    ),
    (
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "gpl",
    ),
    (
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice "
        "this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "bsd",
    ),
    (
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable "
        "for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits",
        "isc",
    ),
    (
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "unlicense",
    ),
)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORT, LONG = 2, 3
#: Diagonals this close are one span; share of a passage's words that makes its label.
GAP, COVER = 3, 0.6


def template_rows() -> list[tuple[int, str, bool, int, int, int, list[str]]]:
    """(template, label, base, k, number of words, position, words of the gram)."""
    out = []
    for t, (text, label, base) in enumerate([(*p, True) for p in PHRASES] + [(*p, False) for p in PASSAGES]):
        w, k = text.split(), SHORT if base else LONG
        out += [(t, label, base, k, len(w), i, w[i : i + k]) for i in range(len(w) - k + 1)]
    return out


def _gram(h, i, k: int):
    return F.xxhash64(*[F.get(h, i + j) for j in range(k)])


def _words(text):
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), SEPARATORS), "")


def _covered(at: Column, k: Column) -> Column:
    """How many words the grams that begin at these positions cover."""
    ends = lambda a, i: F.struct((a.n + F.least(k, i + k - a.end)).alias("n"), (i + k).alias("end"))
    return F.aggregate(F.array_sort(at), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), ends, lambda a: a.n)


def find_spans(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, tpl, label, base, first, last, cover): verified spans as word positions; k1 and k2 stand for the id and the text of a row."""
    rows = spark.createDataFrame(template_rows(), T.StructType.fromDDL("tpl int, label string, base boolean, k int, n int, at int, w array<string>"))
    hashed = F.transform("w", lambda x: F.xxhash64(x))
    rows = rows.withColumn("h", hashed).withColumn("g", F.when(F.col("k") == SHORT, _gram("h", F.lit(0), SHORT)).otherwise(_gram("h", F.lit(0), LONG)))
    d = docs.select(*_key(docs, id_col, text_col), _words(docs[text_col]).alias("w"))
    h = d.where(F.size("w") >= SHORT).withColumn("h", hashed).drop("w")
    grams = lambda k: F.transform(F.sequence(F.lit(0), F.size("h") - k), lambda i: _gram("h", i, k))
    h = h.select("k1", "k2", F.size("h").alias("m"), grams(SHORT).alias("short"), F.when(F.size("h") >= LONG, grams(LONG)).otherwise(F.array().cast("array<bigint>")).alias("long"))
    # both sizes in one array: an index past the short grams is a long gram's
    h = h.select("k1", "k2", F.size("short").alias("m2"), F.posexplode(F.concat("short", "long")).alias("pos", "g"))
    hit = h.join(F.broadcast(rows.drop("w", "h")), "g").where((F.col("pos") < F.col("m2")) == (F.col("k") == SHORT))
    hit = hit.withColumn("p", F.when(F.col("pos") < F.col("m2"), F.col("pos")).otherwise(F.col("pos") - F.col("m2")))
    key = ["k1", "k2", "tpl", "label", "base", "k", "n"]
    diag = hit.groupBy(*key, (F.col("p") - F.col("at")).alias("diag")).agg(F.collect_set("at").alias("seen"), F.min("p").alias("first"), F.max(F.col("p") + F.col("k") - 1).alias("last"))
    w = Window.partitionBy("k1", "k2", "tpl").orderBy("diag")
    apart = (F.col("base") | (F.col("diag") - F.lag("diag").over(w) > GAP)).cast("int")
    runs = diag.withColumn("new", F.coalesce(apart, F.lit(1))).withColumn("run", F.sum("new").over(w))
    # diagonals of a run lie within GAP of each other and a template has a fixed number of positions, so the lists are short where the span fits
    span = runs.groupBy(*key, "run").agg(F.collect_list(F.struct("diag", "seen")).alias("lines"), F.min("first").alias("first"), F.max("last").alias("last"))
    span = span.withColumn("seen", F.array_distinct(F.flatten("lines.seen")))
    cover = F.when(F.col("base"), (F.size("seen") == F.col("n") - F.col("k") + 1).cast("int").cast("double")).otherwise(_covered(F.col("seen"), F.col("k")) / F.col("n"))
    fits = F.col("base") | (F.col("last") - F.col("first") <= 2 * F.col("n") + 4 * LONG)
    span = Workspace(spark, "licenses").save(span.where(fits & (cover >= F.when(F.col("base"), 1.0).otherwise(COVER))), "spans")

    # the words of the spans, compared as text: which of the template's grams stand there
    some, _ = sieve.split(docs, _key(docs, id_col, text_col)[0], span, F.col("k1"))
    some = some.select(*_key(some, id_col, text_col), _words(some[text_col]).alias("w")).dropDuplicates(["k1", "k2"])
    whole = rows.groupBy("tpl").agg(F.sort_array(F.collect_list(F.struct("at", "w"))).alias("t")).select("tpl", F.col("t.w").alias("t"))
    mine = span.join(some.withColumnRenamed("w", "text"), ["k1", "k2"]).join(F.broadcast(whole), "tpl")
    stands = lambda a, diag: F.slice("text", a + diag + 1, F.col("k")) == F.get("t", a)
    true = F.array_distinct(F.flatten(F.transform("lines", lambda x: F.filter(x.seen, lambda a: stands(a, x.diag)))))
    mine = mine.withColumn("seen", true).withColumn("cover", cover)
    return mine.where(F.col("cover") >= F.when(F.col("base"), 1.0).otherwise(COVER)).select("k1", "k2", "tpl", "label", "base", "first", "last", "cover")


def _key(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    return [F.xxhash64(F.lit(n), docs[id_col], docs[text_col]).alias(f"k{n}") for n in (1, 2)]


def scan(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every row of docs: n_words, base places, labels and the best cover as the score."""
    spans = find_spans(spark, docs, id_col, text_col)
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans.groupBy("k1", "k2").agg(
        F.count(F.when(F.col("base"), 1)).alias("n_base"), F.min(F.when(F.col("base"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first"))).cast("long").alias("last_word"), names(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        names(F.col("label")).alias("labels"), F.max("cover").alias("score"),
    )
    d = docs.select(docs[id_col].alias("id"), *_key(docs, id_col, text_col), F.size(_words(docs[text_col])).cast("long").alias("n_words"))
    return d.join(found, ["k1", "k2"], "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def duckdb_sql() -> str:
    """The same result in SQL, from the same fixed tables."""
    rows = ", ".join(f"({t}, '{label}', {base}, {k}, {n}, {i}, '{' '.join(w)}')" for t, label, base, k, n, i, w in template_rows())
    return rf"""
WITH tpl(tpl, label, base, k, n, place, g) AS (VALUES {rows}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, k, p, array_to_string(w[p + 1 : p + k], ' ') AS g FROM d, (VALUES ({SHORT}), ({LONG})) AS s(k), unnest(range(0, len(w) - k + 1)) AS r(p) WHERE len(w) >= k),
diag AS (
  SELECT doc_id, tpl, label, base, tpl.k AS k, n, p - place AS diag, list(DISTINCT place) AS seen, min(p) AS first, max(p + tpl.k - 1) AS last
  FROM g JOIN tpl ON g.g = tpl.g AND g.k = tpl.k GROUP BY ALL
), runs AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id, tpl ORDER BY diag ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, CASE WHEN base OR lag(diag) OVER w IS NULL OR diag - lag(diag) OVER w > {GAP} THEN 1 ELSE 0 END AS new FROM diag WINDOW w AS (PARTITION BY doc_id, tpl ORDER BY diag))
), span AS (
  SELECT doc_id, label, base, k, n, min(first) AS first, max(last) AS last, list_distinct(flatten(list(seen))) AS seen FROM runs GROUP BY doc_id, tpl, label, base, k, n, run
), covered AS (
  SELECT *, CASE WHEN base THEN CAST(len(seen) = n - k + 1 AS DOUBLE) ELSE len(list_distinct(flatten(list_transform(seen, lambda i: range(i, i + k))))) / CAST(n AS DOUBLE) END AS cover FROM span
), ok AS (SELECT * FROM covered WHERE CASE WHEN base THEN cover = 1 ELSE cover >= {COVER} AND last - first <= 2 * n + {4 * LONG} END),
found AS (
  SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(first) FILTER (WHERE base) AS first_word, max(first) FILTER (WHERE base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM ok GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN found USING (doc_id)
"""
