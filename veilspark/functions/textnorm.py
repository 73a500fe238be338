"""Normalisation, lenient matching, counting, chunking, and parsing of model answers."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions.lexicons import CATEGORIES, COUNTED

PLACEHOLDER = r"\[[A-Z_]+\d*\]"


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str]:
    """Characters whose compatibility decomposition is one character and marks, and those characters."""
    source, target = [], []
    for c in map(chr, range(0x80, 0x10000)):
        if not 0xD800 <= ord(c) < 0xE000 and (d := unicodedata.normalize("NFKD", c)) != c:
            base = "".join(x for x in d if not unicodedata.combining(x))
            if len(base) == 1 and c == c.lower():
                source.append(c)
                target.append(base)
    return "".join(source), "".join(target)


def normalized(s: Column) -> Column:
    """Lower case without accents, punctuation and space. Built-in functions; see ``normalized_exact`` for ligatures."""
    low = F.lower(s)
    # ASCII, nearly all spans, needs no table.
    folded = F.when(low.rlike(r"[^\x00-\x7F]"), F.translate(low, *_folds())).otherwise(low)
    return F.regexp_replace(folded, r"(?U)[\p{M}\W]+", "")


@F.pandas_udf(T.StringType())
def normalized_exact(s: pd.Series) -> pd.Series:
    """The same by full compatibility decomposition, in Arrow batches."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        d = unicodedata.normalize("NFKD", x.strip().lower())
        return "".join(c for c in d if (c.isalnum() or c == "_") and not unicodedata.combining(c))

    return s.map(one)


def split_annotation(cell: Column) -> Column:
    """array<struct<orig,norm>> of a ``;`` list; parts without letters or digits fall away, null gives none."""
    parts = F.split(F.coalesce(cell, F.lit("")), ";", -1)
    pairs = F.transform(parts, lambda p: F.struct(F.trim(p).alias("orig"), normalized(p).alias("norm")))
    return F.filter(pairs, lambda p: p["norm"] != "")


def strip_brackets(placeholder: Column) -> Column:
    return F.btrim(placeholder, F.lit("[]"))


def matches(a: Column, b: Column) -> Column:
    """Lenient match of two norms: equal, or both of four characters or more and one within the other."""
    return (a == b) | ((F.length(a) >= 4) & (F.length(b) >= 4) & (F.contains(a, b) | F.contains(b, a)))


def matches_any(norm: Column, predictions: Column) -> Column:
    return F.exists(predictions, lambda p: (p != "") & matches(norm, p))


def placeholder_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rf"\[(?:{'|'.join(COUNTED)})\]"))


def kept_length(text: Column) -> Column:
    """Characters outside placeholders."""
    return F.length(F.regexp_replace(text, PLACEHOLDER, ""))


def chunks(text: Column, limit: int = 450) -> Column:
    """Greedy blocks of whole sentences of at most ``limit`` characters; longer sentences are cut hard."""
    sentences = F.split(text, r"(?U)(?<=[.!?])\s+", -1)
    start = F.struct(F.array().cast("array<string>").alias("blocks"), F.lit("").alias("now"))

    def flush(blocks: Column, now: Column) -> Column:
        return F.when(now == "", blocks).otherwise(F.concat(blocks, F.array(now)))

    def add(state: Column, s: Column) -> Column:
        n = F.greatest(F.lit(0), F.ceil((F.length(s) - limit) / F.lit(limit))).cast("int")  # pieces cut off in front
        cut = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(s, i * limit + 1, F.lit(limit))))
        blocks = F.when(n > 0, F.concat(flush(state["blocks"], state["now"]), cut)).otherwise(state["blocks"])
        now = F.when(n > 0, F.lit("")).otherwise(state["now"])
        rest = F.substring(s, n * limit + 1, F.lit(2**31 - 1))
        fits = F.length(now) + F.length(rest) + 1 <= limit
        return F.struct(
            F.when(fits, blocks).otherwise(flush(blocks, now)).alias("blocks"),
            F.when(fits, F.trim(F.concat(now, F.lit(" "), rest))).otherwise(rest).alias("now"),
        )

    folded = F.aggregate(sentences, start, add, lambda s: flush(s["blocks"], s["now"]))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(folded)


def parse_answer(answer: Column) -> Column:
    """struct of the four categories from a model's answer, or null where no JSON object can be read.

    Thoughts and code fences are cut off, the outermost braces are parsed; a value may be a list or one string, other
    kinds and blank strings fall away.
    """
    bare = F.regexp_replace(answer, r"(?s)<think>.*?</think>", "")
    bare = F.regexp_replace(bare, r"```json\s*|```\s*", "")
    body = F.try_parse_json(F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit("")))

    def strings(key: str) -> Column:
        listed = F.try_variant_get(body, f"$.{key}", "array<variant>")
        texts = F.transform(
            F.filter(listed, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.trim(F.try_variant_get(x, "$", "string"))
        )
        value = F.try_variant_get(body, f"$.{key}", "variant")
        single = F.when(F.schema_of_variant(value) == "STRING", F.array(F.trim(F.try_variant_get(value, "$", "string"))))
        return F.filter(F.coalesce(texts, single, F.array().cast("array<string>")), lambda s: s != "")

    return F.when(body.isNotNull(), F.struct(*[strings(c).alias(c) for c, _, _ in CATEGORIES]))
