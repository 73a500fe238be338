"""Licence detection by diagonal voting, in DataFrame functions only.

Every rolling k-gram of every text is joined to the positions of the same k-gram in the licence templates. A pair of
positions votes for the diagonal (text position minus template position); a copy of a template puts its votes on one
diagonal, inserted or dropped words shift the rest to a neighbouring one. Neighbouring diagonals are merged, and a span
is verified: the words of its k-grams are compared with the template's, and enough of the template's k-grams and words
must stand behind it, closely enough together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


K = 3
#: Diagonals that are no further apart belong to one copy.
SHIFT = 4
#: Shares of a template's k-grams and words that a copy holds, and of a copy's k-grams that are the template's.
COVERAGE, WORDS, DENSITY = 0.6, 0.75, 0.5
#: Template k-grams up to this number are sent to all executors, which leave out all other positions; more are joined by
#: hash. The result is the same.
BROADCAST_GRAMS = 100_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Label and words of short notices and of the opening sentences of common licences.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "licensed under the gnu general public license version"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "this work is licensed under the creative commons attribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def words(text: Column) -> Column:
    """Words of a text. Beyond A-Z, lower() touches only characters that no phrase or template holds."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _row_key() -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")]


def phrase_places(w: Column, phrase: str) -> Column:
    """Starts of the places where the phrase's words stand consecutively."""
    parts = phrase.split(" ")

    def here(i: Column) -> Column:
        out = F.get(w, i) == parts[0]
        for j, p in enumerate(parts[1:], 1):
            out = out & (F.get(w, i + j) == p)
        return out

    none = F.array().cast("array<int>")
    return F.when(F.array_contains(w, parts[-1]), F.filter(F.sequence(F.lit(0), F.size(w) - 1), here)).otherwise(none)


def template_grams(spark: SparkSession, templates=TEMPLATES, k: int = K) -> tuple[DataFrame, list]:
    """(gram, spelt, template, label, at, grams, size), and the k-grams' words."""
    rows = []
    for t, (label, text) in enumerate(templates):
        w = text.split(" ")
        rows += [(w[i : i + k], t, label, i, len(w) - k + 1, len(w)) for i in range(len(w) - k + 1)]
    grams = spark.createDataFrame(rows, "spelt array<string>, template int, label string, at int, grams int, size int")
    return grams.withColumn("gram", F.xxhash64(*[F.get("spelt", F.lit(j)) for j in range(k)])), [r[0] for r in rows]


def template_spans(docs: DataFrame, templates=TEMPLATES, k: int = K, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """(doc_id, t, template, label, first_word, last_word, coverage): verified copies of templates.

    ``t`` is xxhash64 of the text, which keeps rows apart that share a doc_id. Words count from 0.
    """
    table, spelt = template_grams(docs.sparkSession, templates, k)
    small = len(spelt) <= broadcast_grams
    worded = docs.select(*_row_key(), words(F.col("text")).alias("w")).where(F.size("w") >= k)
    gram = lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(k)])
    places = F.sequence(F.lit(0), F.size("w") - k)
    if small:
        hashes = [r.gram for r in table.select("gram").distinct().collect()]  # bounded, as the templates are the caller's
        places = F.filter(places, lambda i: gram(i).isin(*hashes))
    found = F.transform(places, lambda i: F.struct(i.alias("pos"), gram(i).alias("gram"), F.slice("w", i + 1, F.lit(k)).alias("here")))
    rolled = worded.select("doc_id", "t", F.explode(found).alias("x")).select("doc_id", "t", "x.*")
    hits = rolled.join(F.broadcast(table) if small else table, "gram").where("here = spelt").withColumn("diagonal", F.col("pos") - F.col("at"))
    key = ["doc_id", "t", "template", "label", "grams", "size"]
    # A diagonal of one text and template has at most as many votes as the template has k-grams.
    votes = hits.groupBy(*key, "diagonal").agg(F.collect_set("at").alias("ats"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    w = W.partitionBy(*key).orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(w) > SHIFT).cast("int"), F.lit(0))
    copies = votes.withColumn("apart", apart).withColumn("copy", F.sum("apart").over(w))
    merged = copies.groupBy(*key, "copy").agg(
        F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    matched = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + k - 1)))))
    coverage = F.size("ats") / F.col("grams")
    verified = merged.where(
        (coverage >= COVERAGE) & (matched >= WORDS * F.col("size")) & (F.size("ats") >= DENSITY * (F.col("hi") - F.col("lo") + 1))
    )
    return verified.select("doc_id", "t", "template", "label", F.col("lo").alias("first_word"), (F.col("hi") + k - 1).alias("last_word"), coverage.alias("coverage"))


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """One row for each row of ``docs``: word count, places of the phrases, labels and a score.

    ``score``: 1 if a phrase stands there, else the largest share of a template found. Null and empty texts have no
    words, no labels and score 0. Rows that share a doc_id keep their own results; an empty table gives no rows.
    """
    worded = docs.select(*_row_key(), words(F.col("text")).alias("w"))
    placed = worded.select("doc_id", "t", F.size("w").cast("long").alias("n_words"), *[phrase_places(F.col("w"), p).alias(f"p{i}") for i, (p, _) in enumerate(phrases)])
    every = F.concat(*[f"p{i}" for i in range(len(phrases))])
    found = F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)]))
    facts = placed.select(
        "doc_id", "t", "n_words", F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(found)).alias("base"),
    )
    spans = template_spans(docs, templates).groupBy("doc_id", "t").agg(
        F.collect_set("label").alias("added"), F.max("coverage").alias("coverage")
    )
    spans = spans.select(F.col("doc_id").alias("of_id"), F.col("t").alias("of_t"), "added", "coverage")
    both = facts.join(spans, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("t") == F.col("of_t")), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("added", F.array().cast("array<string>"))))
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("coverage", F.lit(0.0))).alias("score"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
