"""Corpora, record outputs and metric tables."""

from __future__ import annotations

import csv
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from veilspark.operators.entities import CATS, COSTS
from veilspark.sources.staging import shared_folder, stage

CAPTURES = "map<string,array<string>>"
OUTPUT = (
    "seq string, text string, redacted string, captures_json string, entities_json string, status string, latency_s double, "
    "prompt_tokens int, completion_tokens int"
)


def read_corpus(spark: SparkSession, path: str, columns: dict[str, str], schema: str | None = None) -> DataFrame:
    """Columns of a corpus by configured name (ours: theirs); ``.csv`` paths are read with a header, others as Parquet."""
    if path.rstrip("/").endswith(".csv"):
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        df = (reader.schema(schema) if schema else reader).csv(path)
    else:
        df = spark.read.parquet(path)
    return df.select(*[F.col(f"`{theirs}`").alias(ours) for ours, theirs in columns.items()])


def first_records(df: DataFrame, n: int, key: str = "seq") -> DataFrame:
    """The first ``n`` records by key; 0 takes all."""
    return df.orderBy(key).limit(n) if n else df


#: Which parts, behind the engine itself, name a configuration of each engine.
TAG_PARTS = {"ner": ("backend",), "llm": ("model",), "hibrido": ("model",), "encadeado": ("model", "order")}


def config_tag(engine: str, **parts: str) -> str:
    """Name of a configuration: its engine and the given ``backend``, ``model`` or ``order``; colons become hyphens."""
    given = (parts.get(p, "").replace(":", "-") for p in TAG_PARTS.get(engine, ()))
    return "_".join([engine, *filter(None, given)])


def to_rows(outputs: DataFrame) -> DataFrame:
    """Record outputs with captures and entities as JSON."""
    return outputs.select(
        F.col("seq").cast("string").alias("seq"), "text", "redacted", F.to_json("captures").alias("captures_json"),
        F.to_json(F.struct(*CATS)).alias("entities_json"), "status",
        *[(F.col(c) if c in outputs.columns else F.lit(None)).cast(t).alias(c) for c, t in COSTS.items()],
    )


def from_rows(rows: DataFrame) -> DataFrame:
    """The inverse; empty JSON cells are empty maps."""
    e = F.coalesce(F.from_json("entities_json", CAPTURES), F.create_map().cast(CAPTURES))
    lists = [F.coalesce(F.element_at(e, F.lit(c)), F.array().cast("array<string>")).alias(c) for c in CATS]
    captures = F.coalesce(F.from_json("captures_json", CAPTURES), F.create_map().cast(CAPTURES)).alias("captures")
    return rows.select(*[c for c in rows.columns if not c.endswith("_json")], captures, *lists)


def write_outputs(outputs: DataFrame, path: str, config: str, csv: bool = False) -> None:
    """One folder per configuration below ``path``: Parquet, or ``;``-separated text with a header."""
    rows = to_rows(outputs).withColumn("config", F.lit(config))
    w = rows.write.mode("append").partitionBy("config")
    w.option("sep", ";").option("header", True).option("quoteAll", True).option("escape", '"').csv(path) if csv else w.parquet(path)


def read_outputs(spark: SparkSession, path: str, csv: bool = False) -> DataFrame:
    """Record outputs of all configurations, with column ``config`` from the folder names."""
    schema = OUTPUT + ", config string"
    if csv:
        r = spark.read.schema(schema).option("sep", ";").option("header", True).option("multiLine", True).option("escape", '"')
        return from_rows(r.csv(path))
    return from_rows(spark.read.schema(schema).parquet(path))


#: What stands behind a configuration's name in the names of its files. A table that Spark wrote is a folder of that name.
STEM = r"([^/]+?)(?:_(?:por_tipo|matriz_erros|top_fn))?\.csv(?:/part-[^/]*)?$"


def read_by_header(spark: SparkSession, pattern: str, schema: str, sep: str = ",") -> DataFrame:
    """Text tables with a header each, columns taken by name: any order, extra ones left out, missing ones null.

    ``config`` is the file's stem, unless the schema names a column so that the files have. Files of one header are read
    together; only headers and file names come to the driver. Files without any line give no rows. Values that don't fit
    their type become null.
    """
    wanted = {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], schema).schema}
    lines = spark.read.text(pattern).where("_metadata.file_block_start = 0").select(F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("at"))
    first = lines.groupBy("path").agg(F.min_by("value", "at").alias("header"))
    parts = None
    for header, rows in groupby(sorted(first.collect(), key=lambda r: r.header), key=lambda r: r.header):
        names = next(csv.reader([header], delimiter=sep))
        as_text = StructType([StructField(f"c{i}", StringType()) for i in range(len(names))])
        r = spark.read.schema(as_text).option("sep", sep).option("header", True).option("enforceSchema", True).option("multiLine", True).option("escape", '"')
        df = r.csv([x.path for x in rows])
        place = {n.strip().lstrip("\ufeff"): f"c{i}" for i, n in reversed(list(enumerate(names)))}
        value = lambda n, t: (F.col(place[n]).try_cast(t) if n in place else F.lit(None).cast(t)).alias(n)
        columns = [value(n, t) for n, t in wanted.items() if n != "config" or n in place]
        config = [] if "config" in wanted and "config" in place else [F.regexp_extract("_metadata.file_path", STEM, 1).alias("config")]
        df = df.select(*columns, *config)
        parts = df if parts is None else parts.unionByName(df)
    return spark.createDataFrame([], schema if "config" in wanted else f"{schema}, config string") if parts is None else parts


def read_csv_outputs(spark: SparkSession, pattern: str) -> DataFrame:
    """Record outputs in one text file per configuration, named by the file's stem; columns by their names."""
    return from_rows(read_by_header(spark, pattern, OUTPUT, ";"))


def write_csv(rows: DataFrame, path: str, sep: str = ",") -> None:
    """A text table with a header at ``path``; parts without rows have none."""
    rows.write.mode("overwrite").option("sep", sep).option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def commit(rows: DataFrame, path: str, batch: str, by: tuple[str, ...] = (), form: str = "parquet") -> None:
    """Adds ``rows`` under the batch's name, taking the place of what the same batch wrote before.

    Only the partitions (``by`` and batch) that occur in ``rows`` are replaced, in one step at the end, so a job that is
    retried or run again leaves one copy, and readers never see a half of it. Run a batch again with the same rows.
    """
    out = rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy(*by, "batch").format(form).save(path)


def write_log(outputs: DataFrame, path: str, batch: str) -> None:
    """Progress log as JSON lines, one batch of it; see ``commit``."""
    extra = [c for c in COSTS if c in outputs.columns]
    commit(outputs.select("seq", "text", "redacted", "captures", F.struct(*CATS).alias("entities"), "status", *extra), path, batch, form="json")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    entities = ", ".join(f"{c}: array<string>" for c in CATS)
    costs = ", ".join(f"{c} {t}" for c, t in COSTS.items())
    return spark.read.schema(f"seq string, text string, redacted string, captures {CAPTURES}, entities struct<{entities}>, status string, {costs}, batch string").json(path)


def write_table(rows: DataFrame, path: str, batch: str) -> None:
    """Metric tables: one more batch of rows, partitioned by configuration; see ``commit``."""
    commit(rows, path, batch, ("config",))


def read_frozen(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Frozen metric tables; config is the file's stem up to its table name, if the files have none themselves."""
    return read_by_header(spark, pattern, schema)


__all__ = ["shared_folder", "stage"]
