"""License scan with a positional index of rare template words, with DataFrame functions only.

Templates are word sequences of license notices; their index maps a word to (template, offset).  One pass over the texts
keeps, of each file, the places of licence words.  Document frequencies of those words over all files give their IDF.
All words of a template's key phrase are mandatory, so the one of highest IDF is looked up alone and proposes where the
template would start; only at these starts are the postings of the template's other words, shifted by their offsets,
intersected; a start counts if enough of the template's words stand there and all words of its key phrase do.  What else
a file holds takes nothing away.  Nothing but licence words is ever exploded or shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Openings of well-known license notices.  (label, notice, mandatory key phrase)
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software", "free of charge"),
    ("mit-released", "released under the mit license", "mit license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
]

#: Words of notices that are too common to be looked up; they are gaps in a template unless a key phrase holds them.
COMMON = "a an and any are be can for in is it of or the this that to under use with without you".split()

#: Share of a notice's words that must stand at their places.
ENOUGH = 0.8

#: Words, in Java's and RE2's syntax, after A-Z are lower-cased.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def templates() -> list[dict]:
    """Number, label, whether base, words to look up as (offset, word, in key phrase)."""
    out = []
    for phrase, label in BASE.items():
        out.append({"label": label, "base": True, "words": [(i, w, True) for i, w in enumerate(phrase.split())]})
    for label, notice, key in NOTICES:
        words, k = notice.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
        inside = range(at, at + len(k))
        out.append({"label": label, "base": False, "words": [(i, w, i in inside) for i, w in enumerate(words) if i in inside or w not in COMMON]})
    return [t | {"template": n} for n, t in enumerate(out)]


def postings() -> list[tuple]:
    """(word, template, offset, key, label, base, size, keys) of each word of each template: a table of fixed size."""
    return [(w, t["template"], i, int(k), t["label"], t["base"], len(t["words"]), sum(x[2] for x in t["words"])) for t in templates() for i, w, k in t["words"]]


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row of docs.

    n_base: places of base phrases; first_word, last_word: their least and largest start, words from 0, null if none;
    labels: distinct, sorted, comma-joined, empty if none; score: the largest share of a template's words found at a
    place that counts, 0 if none.  A null or empty text has no words, an empty table gives no rows.  Rows with one id are rows of their own.
    """
    spark = docs.sparkSession
    index = spark.createDataFrame(postings(), "w string, template int, offset int, key int, label string, base boolean, size int, keys int")
    vocabulary = sorted({p[0] for p in postings()})
    # lower() changes A-Z and letters outside ASCII; of the latter only the Kelvin sign would become an ASCII letter.
    low = F.lower(F.replace(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.lit("K"), F.lit("ª")))
    words = F.filter(F.split(low, GAPS), lambda w: w != "")
    seen = F.filter(F.transform(F.col("words"), lambda w, i: F.when(w.isin(vocabulary), F.struct(w.alias("w"), i.cast("long").alias("i")))), lambda x: x.isNotNull())
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc"), words.alias("words"))
    # Most files hold no licence word at all, which a hash test of the whole array tells.
    some = F.arrays_overlap("words", F.array(*[F.lit(v) for v in vocabulary]))
    files = stage(base.select("row", "doc", F.size("words").cast("long").alias("n_words"), F.when(some, seen).alias("seen")), "licence-words")
    hits = files.filter("seen is not null").select("row", F.explode("seen").alias("x")).select("row", "x.w", "x.i")
    n_files = files.count()
    idf = hits.groupBy("w").agg(F.countDistinct("row").alias("df")).select("w", F.log(F.lit(n_files + 1.0) / (F.col("df") + 1)).alias("idf"))
    # A row for each word of the templates; a word that no file holds is the rarest of all.
    ranked = stage(index.join(F.broadcast(idf), "w", "left").withColumn("rank", F.row_number().over(Window.partitionBy("template").orderBy(F.col("key").desc(), F.col("idf").desc_nulls_first(), "offset"))), "licence-index")
    rare = ranked.filter("rank = 1").select("w", "template", "offset")
    start = (F.col("i") - F.col("offset")).alias("start")
    # Files without any of these words are done; of the others, the rare words are looked up first.
    proposed = hits.join(F.broadcast(rare), "w").select("row", "template", start).distinct()
    rest = hits.join(F.broadcast(ranked.select("w", "template", "offset", "key", "label", "base", "size", "keys")), "w").select("row", "template", start, "key", "label", "base", "size", "keys")
    places = (
        rest.join(proposed, ["row", "template", "start"], "left_semi")
        .groupBy("row", "template", "start", "label", "base", "size", "keys")
        .agg(F.count("*").alias("n"), F.sum("key").alias("k"))
        .filter((F.col("k") == F.col("keys")) & (F.col("n") >= ENOUGH * F.col("size")))
    )
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")  # noqa: E731  labels of templates: a bounded set
    found = places.groupBy("row").agg(
        F.count(F.when(F.col("base"), 1)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.max(F.col("n") / F.col("size")).alias("score"),
    )
    out = files.select("row", "doc", "n_words").join(found, "row", "left")
    return out.select(
        F.col("doc").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("base_labels", "labels")], F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def oracle() -> str:
    """The same in DuckDB's SQL, over documents."""
    rows = ", ".join(f"('{w}', {t}, {o}, {k}, '{label}', {str(b).lower()}, {s}, {ks})" for w, t, o, k, label, b, s, ks in postings())
    return rf"""
WITH post(w, template, "offset", key, label, base, size, keys) AS (VALUES {rows}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
hits AS (SELECT doc_id, ws[i] AS w, i - 1 AS i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d) WHERE ws[i] IN (SELECT w FROM post)),
p AS (SELECT h.doc_id, post.*, h.i - post."offset" AS start FROM hits h JOIN post ON h.w = post.w),
places AS (SELECT doc_id, template, start, label, base, size, count(*) AS n FROM p GROUP BY doc_id, template, start, label, base, size, keys
  HAVING sum(key) = keys AND count(*) >= {ENOUGH} * size),
found AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(n::DOUBLE / size) AS score FROM places GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN found ON found.doc_id = d.doc_id
"""
