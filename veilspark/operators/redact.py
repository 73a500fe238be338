"""Numbering and replacement of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.lexicons import CATEGORIES

LETTER = "[0-9A-Za-zÀ-ÿ]"
SUB = "array<struct<size:int,cat:int,number:int,entity:string,placeholder:string>>"


def whole_word(entity: Column, guarded: bool = False) -> Column:
    """Pattern of an entity as a whole word in any case; ``guarded``: not as the inside of a placeholder."""
    quoted = F.concat(F.lit(r"(?iu:\Q"), F.replace(entity, F.lit(r"\E"), F.lit("")), F.lit(r"\E)"))
    before, after = F.lit(f"(?<!{LETTER})"), F.lit(f"(?!{LETTER})")
    if not guarded:
        return F.concat(before, quoted, after)
    # The look back over a placeholder's start has no fixed length: it is tried only where the word stands.
    inside = F.concat(F.lit(r"(?!(?<=\[[A-Z_]{0,40}\d{0,9})"), quoted, F.lit(r"[A-Z_]*\d*\])"))
    return F.concat(before, F.lit("(?="), quoted, after, F.lit(")"), inside, quoted)


def occurrences(text: Column, placeholder: Column) -> Column:
    """How often a placeholder stands in a text."""
    return ((F.length(text) - F.length(F.replace(text, placeholder, F.lit("")))) / F.length(placeholder)).cast("int")


def numbered(text: Column, entities: Column, category: int, prefix: str, number: bool) -> Column:
    """Entities that stand in the text, by first position; each listing takes a number, repeats included."""
    found = F.transform(entities, lambda e, i: F.struct(F.regexp_instr(text, whole_word(e)).alias("pos"), i.alias("i"), e.alias("e")))
    found = F.array_sort(F.filter(found, lambda x: (x["pos"] > 0) & (F.length(x["e"]) >= 2)))
    name = lambda i: F.concat(F.lit(f"[{prefix}_"), (i + 1).cast("string"), F.lit("]")) if number else F.lit(f"[{prefix}]")
    return F.transform(
        found,
        lambda x, i: F.struct(
            (-F.length(x["e"])).alias("size"), F.lit(category).alias("cat"), i.alias("number"), x["e"].alias("entity"), name(i).alias("placeholder")
        ),
    )


def redacted(text: Column, entities: dict[str, Column], number: bool = True) -> Column:
    """struct<text,count>: longest entities first, one after the other, whole words in any case.

    Existing placeholders and those just put in are never touched. Entities with brackets are skipped.
    """
    lists = [numbered(text, entities[c], i, prefix, number) for i, (c, prefix, _) in enumerate(CATEGORIES) if c in entities]
    subs = F.filter(F.concat(*lists).cast(SUB), lambda s: ~s["entity"].contains("[") & ~s["entity"].contains("]"))

    # Placeholders are never touched, so each replacement makes one more of its own. The last step's are counted in the next
    # one, as its text is at hand then. (Functions of arrays within these would keep a plan from finding the expression again.)
    start = F.struct(text.alias("text"), F.lit(0).alias("count"), F.lit("[]").alias("last"), occurrences(text, F.lit("[]")).alias("had"))

    def counted(state: Column) -> Column:
        return state["count"] + occurrences(state["text"], state["last"]) - state["had"]

    def replace(state: Column, s: Column) -> Column:
        done = F.regexp_replace(state["text"], whole_word(s["entity"], guarded=True), s["placeholder"])
        return F.struct(done.alias("text"), counted(state).alias("count"), s["placeholder"].alias("last"), occurrences(state["text"], s["placeholder"]).alias("had"))

    def finish(state: Column) -> Column:
        return F.struct(state["text"].alias("text"), counted(state).alias("count"))

    none = F.struct(text.alias("text"), F.lit(0).alias("count"))
    any_left = F.lit(False)
    for c in entities:
        any_left = any_left | (F.size(entities[c]) > 0)
    return F.when(any_left, F.aggregate(F.array_sort(subs), start, replace, finish)).otherwise(none)


def redact(df: DataFrame, text: str, out: str, count: str, number: bool = True) -> DataFrame:
    done = redacted(F.col(text), {c: F.col(c) for c, _, _ in CATEGORIES}, number)
    return df.withColumn("__done", done).select(*df.columns, F.col("__done.text").alias(out), F.col("__done.count").alias(count))
