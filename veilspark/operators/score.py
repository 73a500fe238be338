"""Gold tables, matching and scores of any number of configurations.

Matching happens inside a record, on arrays: one join by record id, no second shuffle, no cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspark.functions.lexicons import CATEGORIES, INSTITUTIONAL, LABEL_TYPES, TYPES
from veilspark.functions.textnorm import matches, matches_any, normalized, split_annotation

TIPOS = [t for t, _, _ in TYPES]
STATS = ["tp", "fn", "fp", "leak", "gold"]
TOP = 30


def type_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, label, i) for i, (t, label, _) in enumerate(TYPES)], "tipo string, label string, ord int")


def latest(df: DataFrame, key: str = "seq", version: str | None = None) -> DataFrame:
    """One row for each key: the one of the greatest ``version``, a null version being the least.

    Ties, and all rows where no version is named, go to the greatest row by its columns, in their order. Rows without key
    are one key. The columns must be comparable.
    """
    others = [c for c in df.columns if c not in (key, version)]
    order = [F.col(c) for c in ([version] if version else []) + others]
    best = df.groupBy(F.col(key).alias("__key")).agg(F.max(F.struct(*order)).alias("__row"))
    return best.select(*[F.col("__key").alias(c) if c == key else F.col("__row")[c].alias(c) for c in df.columns])


def gold_arrays(df: DataFrame, key: str = "seq", version: str | None = None) -> DataFrame:
    """(seq, gold array<struct<tipo,orig,norm>>): annotation columns split; institutional codes leave the documents.

    A record that is annotated more than once counts once, by its row of the greatest ``version`` (see ``latest``).
    """

    def entries(tipo: str, column: str) -> Column:
        code = F.when if tipo == "documento" else None
        kind = lambda x: code(x["orig"].rlike("(?iU)" + INSTITUTIONAL), "institucional").otherwise(tipo) if code else F.lit(tipo)
        return F.transform(split_annotation(F.col(column)), lambda x: F.struct(kind(x).alias("tipo"), x["orig"].alias("orig"), x["norm"].alias("norm")))

    lists = [entries(tipo, column) for tipo, _, column in TYPES]
    cells = df.select(F.col(key).cast("string").alias("seq"), *([version] if version else []), *[c for _, _, c in TYPES])
    return latest(cells, "seq", version).select("seq", F.concat(*lists).alias("gold"))


def gold_long(gold: DataFrame) -> DataFrame:
    return gold.select("seq", F.explode("gold").alias("g")).select("seq", "g.tipo", "g.orig", "g.norm")


def gold_profile(gold: DataFrame) -> DataFrame:
    return gold_long(gold).groupBy("tipo").agg(F.count("*").alias("n"))


def _of_captures(captures: Column) -> Column:
    types = F.create_map(*[F.lit(x) for pair in LABEL_TYPES.items() for x in pair])
    return F.flatten(
        F.transform(
            F.map_entries(captures),
            lambda e: F.transform(e["value"], lambda s: F.struct(F.element_at(types, e["key"]).alias("tipo"), normalized(s).alias("norm"))),
        )
    )


def _of_entities(entities: dict[str, Column]) -> list[Column]:
    def of(category: str, tipo: str) -> Column:
        return F.transform(entities[category], lambda s: F.struct(F.lit(tipo).alias("tipo"), normalized(s).alias("norm")))

    return [of(c, t) for c, _, t in CATEGORIES]


def predictions(captures: Column, entities: dict[str, Column]) -> Column:
    """array<struct<tipo,norm>> of captures and entities; hygiene labels have tipo null but count as removed."""
    return F.concat(_of_captures(captures), *_of_entities(entities))


def matched(outputs: DataFrame, gold: DataFrame) -> DataFrame:
    """(config, seq, gold, preds): outputs joined to gold; outputs without gold fall away."""
    preds = predictions(F.col("captures"), {c: F.col(c) for c, _, _ in CATEGORIES})
    out = outputs.select("config", F.col("seq").cast("string").alias("seq"), preds.alias("preds"))
    return out.join(gold, "seq").select("config", "seq", "gold", "preds")


def matched_versions(records: DataFrame, versions: dict[str, dict[str, Column]], gold: DataFrame) -> DataFrame:
    """The same for configurations that share a record's captures: one row of ``records`` and one look-up of gold for all."""
    own = records.select(F.col("seq").cast("string").alias("seq"), _of_captures(F.col("captures")).alias("labelled"), *[F.array(*v.values()).alias(f"v{i}") for i, v in enumerate(versions.values())])
    preds = [F.concat("labelled", *_of_entities({c: F.get(f"v{i}", F.lit(n)) for n, c in enumerate(v)})) for i, v in enumerate(versions.values())]
    all_of = F.array(*[F.struct(F.lit(k).alias("config"), p.alias("preds")) for k, p in zip(versions, preds)])
    both = own.select("seq", all_of.alias("all")).join(gold, "seq")
    return both.select("seq", "gold", F.explode("all").alias("one")).select("one.config", "seq", "gold", "one.preds")


def record_stats(pairs: DataFrame) -> DataFrame:
    """(config, seq, tipo, tp, fn, fp, leak, gold) for all eight types, zeros included."""

    def row(tipo: str) -> Column:
        g, p = F.col(f"g_{tipo}"), F.col(f"p_{tipo}")
        hit = F.filter(g, lambda n: matches_any(n, p))
        lost = F.filter(g, lambda n: ~matches_any(n, F.col("every")))  # of any type, its own too
        over = F.filter(p, lambda q: ~F.exists(g, lambda n: matches(n, q)))
        some = lambda of, value: F.when(F.size(of) > 0, F.size(value)).otherwise(0)
        return F.struct(F.lit(tipo).alias("tipo"), some(g, hit).alias("tp"), some(p, over).alias("fp"), some(g, lost).alias("leak"), F.size(g).alias("gold"))

    def of(array: str, tipo: str) -> Column:
        return F.transform(F.filter(array, lambda x: x["tipo"] == tipo), lambda x: x["norm"])

    # Columns of their own: within one expression each use would be worked out again, most of them for types that a record lacks.
    lists = [c for t in TIPOS for c in (of("gold", t).alias(f"g_{t}"), F.array_distinct(F.filter(of("preds", t), lambda n: n != "")).alias(f"p_{t}"))]
    own = pairs.select("config", "seq", F.array_distinct(F.transform("preds", lambda p: p["norm"])).alias("every"), *lists)
    return own.select("config", "seq", F.explode(F.array(*map(row, TIPOS))).alias("s")).select(
        "config", "seq", "s.tipo", "s.tp", (F.col("s.gold") - F.col("s.tp")).alias("fn"), "s.fp", "s.leak", "s.gold"
    )


def false_positives(pairs: DataFrame) -> DataFrame:
    """(config, seq, tipo, norm): distinct predictions of a type that match no gold of that type."""
    own = F.array_distinct(F.filter("preds", lambda p: p["tipo"].isNotNull() & (p["norm"] != "")))
    over = F.filter(own, lambda p: ~F.exists("gold", lambda g: (g["tipo"] == p["tipo"]) & matches(g["norm"], p["norm"])))
    return pairs.select("config", "seq", F.explode(over).alias("p")).select("config", "seq", "p.tipo", "p.norm")


def match_table(pairs: DataFrame) -> DataFrame:
    """(config, seq, tipo, norm, tp, leak): the fate of each gold entity; institutional codes are not scored."""
    p = lambda t: F.transform(F.filter("preds", lambda x: x["tipo"] == t), lambda x: x["norm"])
    every = F.transform("preds", lambda x: x["norm"])
    fates = F.transform(
        F.filter("gold", lambda g: g["tipo"] != "institucional"),
        lambda g: F.struct(
            g["tipo"].alias("tipo"), g["norm"].alias("norm"), matches_any(g["norm"], p(g["tipo"])).alias("tp"), matches_any(g["norm"], every).alias("any")
        ),
    )
    return pairs.select("config", "seq", F.explode(fates).alias("f")).select("config", "seq", "f.tipo", "f.norm", "f.tp", (~F.col("f.tp") & ~F.col("f.any")).alias("leak"))


def institutional_removed(pairs: DataFrame) -> DataFrame:
    """(config, total, removed): institutional codes, and how many went under any label."""
    every = F.transform("preds", lambda x: x["norm"])
    codes = F.filter("gold", lambda g: g["tipo"] == "institucional")
    return pairs.groupBy("config").agg(
        F.sum(F.size(codes)).cast("long").alias("total"), F.sum(F.size(F.filter(codes, lambda g: matches_any(g["norm"], every)))).cast("long").alias("removed")
    )


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _rates(tp: Column, fn: Column, fp: Column) -> dict[str, Column]:
    recall, precision = ratio(tp, tp + fn), ratio(tp, tp + fp)
    return {"recall": recall, "precision": precision, "f1": ratio(2 * recall * precision, recall + precision), "accuracy": ratio(tp, tp + fn + fp)}


def totals(stats: DataFrame) -> DataFrame:
    return stats.groupBy("config", "tipo").agg(*[F.sum(c).cast("long").alias(c) for c in STATS])


def totals_rollup(stats: DataFrame) -> DataFrame:
    """(config, tipo, sums): by type, and over all types where tipo is null."""
    return stats.rollup("config", "tipo").agg(F.grouping_id().alias("level"), *[F.sum(c).cast("long").alias(c) for c in STATS]).where("level < 3").drop("level")


def scores_by_type(sums: DataFrame) -> DataFrame:
    r = _rates(F.col("tp"), F.col("fn"), F.col("fp"))
    safety = F.when(F.col("gold") > 0, 1 - F.col("leak") / F.col("gold")).otherwise(F.lit(0.0))
    return sums.select("*", *[v.alias(k) for k, v in r.items()], safety.alias("safety_recall"))


def error_table(sums: DataFrame) -> DataFrame:
    return sums.select("config", "tipo", F.col("fn").alias("fn_total"), F.col("leak").alias("leaked"), (F.col("fn") - F.col("leak")).alias("removed_otherwise"))


def top_misses(stats: DataFrame, most: int = TOP) -> DataFrame:
    """(config, seq, n_fn): the records with the most misses of each configuration; ties by descending id."""
    misses = stats.groupBy("config", "seq").agg(F.sum("fn").cast("long").alias("n_fn")).where("n_fn > 0")
    w = W.partitionBy("config").orderBy(F.desc("n_fn"), F.desc("seq"))
    return misses.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("config", "seq", "n_fn")


def summary(sums: DataFrame) -> DataFrame:
    """One row per configuration: micro and macro rates and three recalls."""
    by_type = scores_by_type(sums)
    grouped = by_type.groupBy("config").agg(
        *[F.sum(c).alias(c) for c in STATS], F.avg("f1").alias("macro_f1"), F.avg("safety_recall").alias("macro_safety"),
        *[F.max(F.when(F.col("tipo") == t, F.col("recall"))).alias(f"recall_{t}") for t in ("nome", "local", "documento")],
    )
    r = _rates(F.col("tp"), F.col("fn"), F.col("fp"))
    return grouped.select(
        "config", r["recall"].alias("micro_recall"), r["precision"].alias("micro_precision"), r["f1"].alias("micro_f1"),
        "macro_f1", "macro_safety", "recall_nome", "recall_local", "recall_documento", *[F.col(c) for c in STATS],
    )


def comparison(sums: DataFrame, costs: DataFrame) -> DataFrame:
    """Twelve columns per configuration; ``costs`` is (config, n, mean_latency, mean_completion)."""
    s = summary(sums).drop(*STATS)
    return s.join(costs, "config").select("config", "n", *[c for c in s.columns if c != "config"], "mean_latency", "mean_completion")
