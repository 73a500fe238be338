"""Incremental secret scan over content-addressed blobs, in DataFrame functions only.

Every version of every file is a row (path, text). A text is named by its SHA-256; the ledger in shared storage holds,
for each blob, the rule versions that have been run on it and what they found. A run looks for pairs of blob and rule
version that the ledger lacks, reads one copy of each such blob, scans it with just those rules, appends to the ledger
and joins the findings back to all paths of the batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import materialize, shared_dir

LEDGER = "blob binary, rules array<string>, findings array<struct<rule:string,kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (leftmost, non-overlapping) whose ``group`` has ``least`` characters or more.

    ``needs``: a text without any of these strings can't match. A changed rule gets another version, and so a new scan.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    needs: tuple[str, ...] = ()
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The three base kinds, in the order that breaks ties of position.
BASE = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""",
        group=2, least=12, needs=(":", "="),
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=18, needs=("AKIA",)),
    Rule("hex", r"[0-9a-f]{16,}", least=16),
)
#: Kinds that the scan adds.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", needs=("-----BEGIN",)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", needs=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needs=("eyJ",)),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", needs=("xox",)),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", needs=("AIza",)),
    Rule("live", r"[rs]k_live_[A-Za-z0-9]{16,}", needs=("k_live_",)),
)
RULES = BASE + MORE


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<rule,kind,start,end>> in code points, end exclusive.

    The pieces between matches and the matches themselves alternate, so that their lengths add up to the positions.
    """
    p = F.lit(rule.pattern)
    found = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, p, F.lit(0)), F.length).alias("size"),
        F.transform(F.regexp_extract_all(text, p, F.lit(rule.group)), F.length).alias("told"),
    )
    none = F.array().cast("array<struct<rule:string,kind:string,start:int,end:int>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        span = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.kind).alias("kind"), start.alias("start"), (start + x["size"]).alias("end"))
        good = F.coalesce(x["told"] >= rule.least, F.lit(False))
        return F.struct(
            (start + F.coalesce(x["size"], F.lit(0))).alias("at"),
            F.when(good, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"),
        )

    scan = F.aggregate(found, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])
    may = text.rlike(rule.pattern)
    if rule.needs:
        some = text.contains(rule.needs[0])
        for s in rule.needs[1:]:
            some = some | text.contains(s)
        may = some & may
    return F.when(may, scan).otherwise(none)


def blob(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


class BlobLedger:
    """Append-only Parquet table of scanned (blob, rule version) pairs and their findings."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        """``path``: an existing or new folder that all executors share."""
        self.spark, self.path = spark, path or shared_dir(spark)
        try:
            self.rows()
        except AnalysisException:  # a new one
            spark.createDataFrame([], LEDGER).write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def of(self, blobs: DataFrame) -> DataFrame:
        """The entries of ``blobs`` alone: what is grouped afterwards grows with the batch, not with the ledger."""
        return self.rows().join(blobs.select("blob"), "blob", "left_semi")

    def append(self, scanned: DataFrame) -> None:
        scanned.select("blob", "rules", "findings").write.mode("append").parquet(self.path)


def scan(docs: DataFrame, ledger: BlobLedger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, findings) for each row of ``docs``: findings of its blob by ``rules``, sorted by start, then kind.

    Null text counts as empty, and an empty text has no findings. Rows that share a text share one scan, whoever holds
    them; missing or repeated doc_ids are of no account. Other columns are ignored. An empty table gives no rows.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    names = F.array(*[F.lit(r.name) for r in rules])
    paths = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), blob().alias("blob")))
    copies = materialize(paths.groupBy("blob").agg(F.min("doc_id").alias("one_id")))
    done = ledger.of(copies).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
    todo = copies.join(done, "blob", "left").select(
        F.col("blob").alias("todo_blob"), "one_id", F.array_except(names, F.coalesce("done", F.array().cast("array<string>"))).alias("rules")
    )
    todo = materialize(todo.where(F.size("rules") > 0))
    # One copy of each unseen blob: texts are dealt by their own id, so that a blob with many copies fills no task.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), blob().alias("blob"))
    unseen = texts.join(
        todo.hint("shuffle_hash"), (F.col("blob") == F.col("todo_blob")) & F.col("doc_id").eqNullSafe(F.col("one_id"))
    )
    # A rule that a blob has seen gets no text, and so finds nothing.
    runs = [spans(F.when(F.array_contains("rules", r.name), F.col("text")), r) for r in rules]
    scanned = unseen.select("blob", "rules", F.concat(*runs).alias("findings"))
    ledger.append(scanned)
    hits = ledger.of(copies).where(F.size("findings") > 0)
    order = F.create_map(*[v for i, r in enumerate(rules) for v in (F.lit(r.kind), F.lit(i))])
    every = hits.groupBy("blob").agg(F.flatten(F.collect_set("findings")).alias("every"))
    found = materialize(every.select("blob", _ordered(F.col("every"), names, order).alias("findings")))
    return paths.join(found, "blob", "left").select(
        "doc_id", F.coalesce("findings", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")).alias("findings")
    )


def _ordered(every: Column, names: Column, order: Column) -> Column:
    wanted = F.filter(F.array_distinct(every), lambda x: F.array_contains(names, x["rule"]))
    placed = F.transform(
        wanted,
        lambda x: F.struct(
            x["start"].alias("start"), F.element_at(order, x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")
        ),
    )
    return F.array_sort(placed)


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("findings", lambda x: x["kind"].isin(*[r.kind for r in BASE]))
    return found.select(
        "doc_id",
        *[count(r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
    )


def _oracle() -> str:
    kinds = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''").replace("(?i:", "(?i)(") if r.pattern.startswith("(?i:") else r.pattern.replace("'", "''")
        group = r.group + 1 if r.pattern.startswith("(?i:") and r.group else r.group
        kinds.append(
            f"SELECT doc_id, {i} AS rank, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(text, '{p}') AS gaps, "
            f"regexp_extract_all(text, '{p}') AS hits, regexp_extract_all(text, '{p}', {group}) AS told FROM d WHERE regexp_matches(text, '{p}')"
        )
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), k AS (" + " UNION ALL ".join(kinds) + "), "
        "u AS (SELECT *, unnest(generate_series(1, len(hits))) AS i FROM k), "
        "s AS (SELECT doc_id, rank, kind, least, length(told[i]) AS n, "
        "list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS a, length(hits[i]) AS w FROM u), "
        "g AS (SELECT doc_id, rank, kind, a, concat_ws(':', kind, CAST(a AS BIGINT), CAST(a + w AS BIGINT)) AS span FROM s WHERE n >= least), "
        "t AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, "
        "count(*) FILTER (WHERE rank = 2) AS n_hex, string_agg(span, ',' ORDER BY a, rank) FILTER (WHERE rank < 3) AS base, "
        "string_agg(span, ',' ORDER BY a, rank) AS spans FROM g GROUP BY doc_id) "
        "SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, "
        "sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN t ON d.doc_id = t.doc_id"
    )


SQL = _oracle()
