"""The record pipeline: detectors, entities, replacement, validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.detectors import stage1
from veilspark.functions.textnorm import placeholder_count
from veilspark.operators import entities as ent
from veilspark.operators.redact import redact, redacted
from veilspark.sources.io import stage

Source = Callable[[DataFrame], DataFrame]


def valid(before: Column, after: Column) -> Column:
    """No detector placeholder is lost, and a text of over 50 characters keeps 30 % of its length."""
    return ~((placeholder_count(after) < placeholder_count(before)) | ((F.length(before) > 50) & (F.length(after) < F.length(before) * 0.3)))


def _prefix(df: DataFrame) -> str:
    """The start of names that no column of ``df`` has: sources keep lists of their own, and chains may be nested."""
    prefix = "__first_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix = f"_{prefix}"
    return prefix


def _parked(df: DataFrame, prefix: str) -> DataFrame:
    """Entities and costs under other names, so that a second source can add its own."""
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in (*ent.CATS, *ent.COSTS) if c in df.columns})


def _merged(df: DataFrame, kept: list, prefix: str) -> DataFrame:
    """Both sources' entities, without repeats of a norm, and the sums of their costs."""
    both = [ent.united(F.col(f"{prefix}{c}"), F.col(c)).alias(c) for c in ent.CATS]
    costs = []
    for c, t in ent.COSTS.items():
        given = [F.coalesce(F.col(x), F.lit(0)) for x in (f"{prefix}{c}", c) if x in df.columns]
        costs += [sum(given[1:], given[0]).cast(t).alias(c)] if given else []
    return df.select(*kept, *both, *costs)


def chained(first: Source, second: Source, text: str = "stage1_text") -> Source:
    """The second source sees the text without what the first one found; both lists are united."""

    def run(df: DataFrame) -> DataFrame:
        prefix = _prefix(df)
        whole, rest = f"{prefix}whole", f"{prefix}part"
        a = ent.filter_entities(first(df))
        part = redacted(F.col(text), {c: F.col(c) for c in ent.CATS}, number=False)["text"]
        a = _parked(a.withColumn(rest, part).withColumnRenamed(text, whole).withColumnRenamed(rest, text), prefix)
        return _merged(ent.filter_entities(second(a)), [F.col(whole).alias(c) if c == text else F.col(c) for c in df.columns], prefix)

    return run


def union(first: Source, second: Source) -> Source:
    """Entities of both sources, each filtered; the first spelling of a norm stays."""

    def run(df: DataFrame) -> DataFrame:
        prefix = _prefix(df)
        return _merged(ent.filter_entities(second(_parked(ent.filter_entities(first(df)), prefix))), list(df.columns), prefix)

    return run


def finish(found: DataFrame) -> DataFrame:
    """Replaces, validates, and falls back to the detectors' text where validation fails.

    Costs of the source stay with the record; without any they are zero.
    """
    found = found.withColumns({c: F.lit(0).cast(t) for c, t in ent.COSTS.items() if c not in found.columns})
    done = redact(found, "stage1_text", "__text", "replaced")
    ok = valid(F.col("stage1_text"), F.col("__text"))
    blank = F.col("stage1_text") == ""
    others = [c for c in done.columns if c not in (*ent.CATS, "__text", "replaced")]
    return done.withColumn("__ok", ok).select(
        *others,
        F.when(F.col("__ok"), F.col("__text")).otherwise(F.col("stage1_text")).alias("redacted"),
        *[F.when(F.col("__ok"), F.col(c)).otherwise(ent.no_entities()).alias(c) for c in ent.CATS],
        F.when(F.col("__ok"), F.col("replaced")).otherwise(F.lit(0)).alias("replaced"),
        F.when(blank, "vazio").when(F.col("__ok"), "ok").otherwise("fallback_estagio1").alias("status"),
    )


def steps(df: DataFrame, source: Source = ent.source_none) -> DataFrame:
    """Detectors, source, filter, replacement and validation as one plan; batches and streams alike."""
    return finish(ent.filter_entities(source(stage1(df))))


def anonymize(df: DataFrame, source: Source = ent.source_none) -> DataFrame:
    """``df`` (seq, text, ...) with stage1_text, captures, the four entity columns, redacted, replaced, status and costs.

    Costs are latency_s (the source's time), prompt_tokens and completion_tokens. Null and blank texts give empty texts,
    status ``vazio`` and no costs. Detectors, replacement, models and small dictionaries are narrow; stored mentions,
    large dictionaries and models with a limit of length shuffle.
    """
    # Written once: sources read the detectors' text more than once.
    return finish(ent.filter_entities(source(stage(stage1(df)))))


def status_counts(outputs: DataFrame) -> DataFrame:
    return outputs.groupBy("config", "status").agg(F.count("*").alias("n"))


def mean_costs(outputs: DataFrame) -> DataFrame:
    """(config, n, mean_latency, mean_prompt, mean_completion); missing figures count as zero."""
    mean = lambda c: F.avg(F.coalesce(F.col(c), F.lit(0)).cast("double"))
    return outputs.groupBy("config").agg(
        F.count("*").alias("n"), mean("latency_s").alias("mean_latency"), mean("prompt_tokens").alias("mean_prompt"), mean("completion_tokens").alias("mean_completion")
    )


def pending(inputs: DataFrame, done: DataFrame, key: str = "seq") -> DataFrame:
    """Records that an earlier run hasn't finished, by key."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


#: Named choices of sources: which of the given ones take part, and how.
PRESETS: dict[str, Callable[..., Source]] = {
    "light": lambda **_: ent.source_none,
    "model": lambda a, **_: a,
    "union": lambda a, b, **_: union(a, b),
    "chained_ab": lambda a, b, **_: chained(a, b),
    "chained_ba": lambda a, b, **_: chained(b, a),
}
