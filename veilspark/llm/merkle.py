"""Merkle manifest of a dataset: 8-ary trees over range-sorted rows, one for each group, and one over the groups' roots.

Leaves are dealt by range of (group, key) and sorted, so a group is a run of neighbouring partitions. Row counts of the
partitions' first and last groups give the offset at which each partition enters a group's tree; that is all the driver
sees. Each partition then builds every subtree whose leaves it holds completely. What is left, at most seven nodes on
either side of a level, is shuffled by coordinate (group, level, index) and finished level by level. The upper ends of the
proofs go back to the partitions they came from, where every row's proof is put together and folded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import materialize

ARITY = 8
#: Leaves of a range partition on average; bounds what a task holds.
RANGE_ROWS = 100_000
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(c):
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(text):
    return F.sha2(F.concat(*[_field(text if c == "text" else F.col(c)) for c in FIELDS]).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(grp, key, leaf, other): the row's digest, and that of the row as it is checked, tampered with where 3 divides the id's CRC."""
    rows = docs.select(*FIELDS)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    other = F.when(hit, leaf(F.translate("text", UPPER, LOWER)))
    made = rows.select(F.col("lang").alias("grp"), F.col("doc_id").alias("key"), leaf(F.col("text")).alias("leaf"), other.alias("other"))
    return made.withColumn("other", F.coalesce("other", "leaf"))


def ranged(made: DataFrame, rows_per_range: int = RANGE_ROWS) -> DataFrame:
    """``made`` (grp, key, leaf, other) with pid and local: range partition and place in it, by (grp, key, leaf), nulls first.

    Equal rows are told apart by a number of their own, so that any number of them spreads over the ranges.
    """
    spark = made.sparkSession
    made = materialize(made.withColumn("tie", F.monotonically_increasing_id()))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-made.count() // rows_per_range))
    order = [F.asc_nulls_first(c) for c in ("grp", "key", "leaf", "tie")]
    placed = made.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    at = F.col("__at")
    pid, local = F.shiftright(at, 33).cast("int"), at.bitwiseAND((1 << 33) - 1)
    return materialize(placed.select("grp", "key", "leaf", "other", pid.alias("pid"), local.alias("local")))


def offsets(placed: DataFrame) -> dict[int, tuple[int, int, int]]:
    """pid -> (offset of its first group, size of its first group, size of its last group): constant size a partition.

    Groups in between lie whole in their partition.
    """
    name = F.coalesce(F.sha2(F.col("grp").cast("string"), 256), F.lit(""))
    pieces = placed.groupBy("pid", "grp").agg(F.count("*").alias("n"), F.min("local").alias("begin"))
    ends = pieces.groupBy("pid").agg(
        F.min(F.struct("begin", name.alias("name"), "n")).alias("a"), F.max(F.struct("begin", name.alias("name"), "n")).alias("z")
    )
    rows = sorted(ends.select("pid", "a.name", "a.n", F.col("z.name").alias("last"), F.col("z.n").alias("last_n"), (F.col("a.begin") == F.col("z.begin")).alias("one")).collect())
    before, size, first = {}, {}, {}  # rows of the group before the partition; size of a group that is a first or last one
    for r in rows:
        before[r.pid] = size.get(r.name, 0)
        for group, n in ((r.name, r.n), *(() if r.one else ((r.last, r.last_n),))):
            size[group] = size.get(group, 0) + n
        first[r.pid] = r
    return {p: (before[p], size[r.name], size[r.last]) for p, r in first.items()}


class Piece:
    """The neighbouring nodes of one group's tree that a partition holds, and all that can be built of them alone.

    ``levels[l]`` is (index of the first node, nodes); a node has its parent here if all of that parent's children are.
    """

    def __init__(self, nodes: list[str], start: int, size: int):
        self.size, self.levels = size, [(start, nodes)]
        while size > 1:
            end = start + len(nodes)
            first, last = -(-start // ARITY), (-(-end // ARITY) if end == size else end // ARITY)
            if first >= last:
                break
            nodes = [digest(*nodes[i * ARITY - start : (i + 1) * ARITY - start]) for i in range(first, last)]
            start, size = first, -(-size // ARITY)
            self.levels.append((start, nodes))

    def whole(self, level: int, i: int) -> bool:
        """Whether the parent of node ``i`` of ``level`` is built here."""
        if level + 1 >= len(self.levels):
            return False
        start, nodes = self.levels[level + 1]
        return start <= i // ARITY < start + len(nodes)

    def ragged(self) -> Iterator[tuple[int, int, str]]:
        """(level, index, node) of the nodes without a parent here."""
        for level, (start, nodes) in enumerate(self.levels):
            for i, node in enumerate(nodes, start):
                if not self.whole(level, i):
                    yield level, i, node

    def path(self, i: int) -> tuple[list[tuple[str, str]], int, int]:
        """Siblings (before, after) of leaf ``i`` level by level as far as they are here, and the ragged node it ends in."""
        out, level = [], 0
        while self.whole(level, i):
            start, nodes = self.levels[level]
            run = i // ARITY * ARITY
            out.append(("".join(nodes[max(run, start) - start : i - start]), "".join(nodes[i + 1 - start : run + ARITY - start])))
            level, i = level + 1, i // ARITY
        return out, level, i


def _pieces(table: pa.Table, place: dict[int, tuple[int, int, int]]) -> Iterator[tuple[str | None, list[int], Piece]]:
    """(group, rows, piece) of one range partition's leaves; ``rows`` are places in ``table`` in the order of the leaves."""
    order = table.column("local").to_numpy().argsort(kind="stable").tolist()
    groups, nodes, pid = table.column("grp").to_pylist(), table.column("leaf").to_pylist(), table.column("pid")[0].as_py()
    before, first_size, last_size = place[pid]
    at = 0
    while at < len(order):
        end = at
        while end < len(order) and groups[order[end]] == groups[order[at]]:
            end += 1
        rows = order[at:end]
        start = before if at == 0 else 0
        size = first_size if at == 0 else last_size if end == len(order) else len(rows)
        yield groups[rows[0]], rows, Piece([nodes[r] for r in rows], start, size)
        at = end


RAGGED = "pid int, grp string, level int, idx long, node string, size long"


def ragged_nodes(placed: DataFrame, place: dict) -> DataFrame:
    """(pid, grp, level, idx, node, size): nodes whose parents need more than their partition; size is that of their level."""

    def run(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {c.split()[0]: [] for c in RAGGED.split(", ")}
        for grp, _, piece in _pieces(table, place):
            for level, i, node in piece.ragged():
                size = piece.size
                for _ in range(level):
                    size = -(-size // ARITY)
                for c, v in zip(out, (table.column("pid")[0].as_py(), grp, level, i, node, size)):
                    out[c].append(v)
        types = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64()]
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    return placed.groupBy("pid").applyInArrow(run, RAGGED)


def climbed(ragged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upper ends of the ragged nodes' proofs (pid, grp, level, idx, before, after), and the trees' tops (grp, top).

    Upwards, each round shuffles one level's nodes by their parent's coordinate, eight to a run at most. Downwards, each
    node takes its own siblings and then its parent's: ``before`` and ``after`` hold them level by level.
    """
    height = ragged.agg(F.max("level")).first()[0]
    runs, tops, carried, level = [], [], None, 0
    while height is not None and (level <= height or carried is not None):
        here = ragged.where(F.col("level") == level).select("grp", "idx", "node", "size")
        here = here if carried is None else here.unionByName(carried)
        tops.append(here.where("size = 1").select("grp", F.col("node").alias("top")))
        up = [F.expr(f"idx div {ARITY}").alias("idx"), F.expr(f"(size + {ARITY - 1}) div {ARITY}").alias("size")]
        run = F.array_sort(F.collect_list(F.struct(F.col("idx").alias("i"), "node"))).alias("run")
        made = here.where("size > 1").select("grp", "idx", "node", "size").groupBy("grp", *up).agg(run)
        node = F.sha2(F.array_join(F.transform("run", lambda x: x["node"]), "").cast("binary"), 256)
        made = materialize(made.withColumn("node", node))
        runs.append(made)
        carried = None if made.isEmpty() else made.select("grp", "idx", "node", "size")
        level += 1
    none, upper, above = F.array().cast("array<string>"), [], None
    for level in reversed(range(len(runs))):
        text = lambda at, n: F.array_join(F.transform(F.slice("run", at, n), lambda x: x["node"]), "")
        each = runs[level].select("grp", F.col("idx").alias("parent"), "run", F.explode(F.sequence(F.lit(1), F.size("run"))).alias("k"))
        own = each.select("grp", "parent", F.element_at("run", F.col("k"))["i"].alias("idx"), text(F.lit(1), F.col("k") - 1).alias("b"), text(F.col("k") + 1, F.size("run")).alias("a"))
        if above is None:
            paths = own.select("grp", "idx", F.array("b").alias("before"), F.array("a").alias("after"))
        else:
            p = above.select(F.col("grp").alias("g"), F.col("idx").alias("i"), "before", "after")
            both = own.join(p, F.col("grp").eqNullSafe(F.col("g")) & (F.col("parent") == F.col("i")), "left")
            paths = both.select("grp", "idx", *[F.concat(F.array(x), F.coalesce(c, none)).alias(c) for x, c in (("b", "before"), ("a", "after"))])
        above = materialize(paths)
        mine = ragged.where(F.col("level") == level).select("pid", F.col("grp").alias("g"), "level", F.col("idx").alias("i"))
        both = mine.join(above, F.col("grp").eqNullSafe(F.col("g")) & (F.col("idx") == F.col("i")), "left")
        upper.append(both.select("pid", F.col("g").alias("grp"), "level", F.col("i").alias("idx"), F.coalesce("before", none).alias("before"), F.coalesce("after", none).alias("after")))
    if not upper:
        empty = ragged.select("pid", "grp", "level", "idx", none.alias("before"), none.alias("after"))
        return empty, ragged.select("grp", F.col("node").alias("top"))
    return materialize(reduce(DataFrame.unionByName, upper)), materialize(reduce(DataFrame.unionByName, tops))


def _walked(placed: DataFrame, place: dict, upper: DataFrame, emit: Callable, schema: str) -> DataFrame:
    """``emit`` of every leaf (row of ``placed`` as a dict, before, after): its siblings level by level up to the top."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(leaves: pa.Table, ends: pa.Table) -> pa.Table:
        if not leaves.num_rows:
            return arrow.empty_table()
        rest = {(e["grp"], e["level"], e["idx"]): list(zip(e["before"], e["after"])) for e in ends.to_pylist()}
        rows, out = leaves.to_pylist(), []
        for grp, at, piece in _pieces(leaves, place):
            for i, row in enumerate(at, piece.levels[0][0]):
                own, level, top = piece.path(i)
                out.append(emit(rows[row], own + rest[grp, level, top]))
        return pa.Table.from_pylist(out, schema=arrow)

    return placed.groupBy("pid").cogroup(upper.groupBy("pid")).applyInArrow(run, schema)


class Tree:
    """The trees over ``made`` (grp, key, leaf, other), one for each group, without their upper proofs put together yet."""

    def __init__(self, made: DataFrame, rows_per_range: int = RANGE_ROWS):
        self.placed = ranged(made, rows_per_range)
        self.place = offsets(self.placed)
        self.upper, self.tops = climbed(materialize(ragged_nodes(self.placed, self.place)))

    def paths(self) -> DataFrame:
        """(key, before, after) of every leaf: its siblings level by level."""
        emit = lambda row, path: {"key": row["key"], "before": [x for x, _ in path], "after": [x for _, x in path]}
        kind = dict(self.placed.dtypes)["key"]
        return _walked(self.placed, self.place, self.upper, emit, f"key {kind}, before array<string>, after array<string>")


def manifest(docs: DataFrame, rows_per_range: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row for each row of ``docs``.

    Groups are the values of ``lang``, null one of them. Leaves of a group ascend by doc_id, nulls first, then by digest;
    equal rows take neighbouring places. A null field is ``-`` in the leaf, unlike an empty text. Rows without doc_id are
    never tampered with. An empty table gives no rows; other columns are ignored.
    """
    tree = Tree(leaves(docs), rows_per_range)
    groups = Tree(tree.tops.select(F.lit(None).cast("string").alias("grp"), F.col("grp").alias("key"), F.col("top").alias("leaf"), F.col("top").alias("other")), rows_per_range)
    first = groups.tops.first()
    root = first.top if first else ""
    # A row for each group: the way from its top to the root.
    ways = materialize(groups.paths().select(F.col("key").alias("name"), F.col("before").alias("b"), F.col("after").alias("a")))
    ways = tree.tops.join(ways, F.col("grp").eqNullSafe(F.col("name"))).select(F.col("grp").alias("name"), F.col("top"), "b", "a")
    ends = tree.upper.join(materialize(ways), F.col("grp").eqNullSafe(F.col("name")))
    ends = ends.select("pid", "grp", "level", "idx", F.concat("before", "b", F.array("top")).alias("before"), F.concat("after", "a", F.array(F.lit(""))).alias("after"))

    def emit(row: dict, path: list[tuple[str, str]]) -> dict:
        *path, (subroot, _) = path
        node = row["other"]
        for before, after in path:
            node = digest(before, node, after)
        proof = digest(*[x for pair in path for x in pair])
        return {"doc_id": row["key"], "leaf": row["leaf"], "subroot": subroot, "root": root, "proof_sha256": proof, "folded_root": node, "verified": node == root}

    kind = dict(tree.placed.dtypes)["key"]
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _walked(tree.placed, tree.place, materialize(ends), emit, schema)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql(levels: int = 12) -> str:
    """The same rows by level-wise grouping; trees of up to 8^``levels`` leaves."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    row = lambda text: "sha256(" + " || ".join(text if c == "text" else field(c) for c in FIELDS) + ")"
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    step = "(c >> 1) ^ (3988292384 * (c & 1))"
    crc = (
        "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), "
        f"lambda s, x: list_reduce(list_prepend(xor(s, x), generate_series(1::BIGINT, 8::BIGINT)), lambda c, k: {step.replace(') ^ (', '), (').replace('(c >> 1)', 'xor((c >> 1)')})))"
    )
    parts = [
        f"l0 AS MATERIALIZED (SELECT doc_id, lang, {row(field('text'))} AS leaf, CASE WHEN xor({crc}, 4294967295) % 3 = 0 THEN {row(field(low))} ELSE {row(field('text'))} END AS other FROM documents)",
        "l AS MATERIALIZED (SELECT *, row_number() OVER () AS r, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS BIGINT) AS i, count(*) OVER (PARTITION BY lang) AS n FROM l0)",
    ]

    def tree(p: str, source: str) -> None:
        """CTEs {p}_top (g, h) and {p}_way (id, b, a) over ``source`` (id, g, i, n, h)."""
        parts.append(f"{p}n0 AS MATERIALIZED (SELECT g, i, n, h FROM {source})")
        parts.append(f"{p}w0 AS MATERIALIZED (SELECT id, g, i, n, []::VARCHAR[] AS b, []::VARCHAR[] AS a FROM {source})")
        for k in range(levels):
            parts.append(f"{p}r{k} AS MATERIALIZED (SELECT g, CASE WHEN n > 1 THEN i // {ARITY} ELSE i END AS j, n, list(h ORDER BY i) AS hs FROM {p}n{k} GROUP BY ALL)")
            parts.append(f"{p}n{k + 1} AS MATERIALIZED (SELECT g, j AS i, (n + {ARITY - 1}) // {ARITY} AS n, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {p}r{k})")
            parts.append(
                f"{p}w{k + 1} AS MATERIALIZED (SELECT id, w.g, j AS i, (w.n + {ARITY - 1}) // {ARITY} AS n, "
                f"CASE WHEN w.n > 1 THEN list_append(b, array_to_string(hs[1:i % {ARITY}], '')) ELSE b END AS b, "
                f"CASE WHEN w.n > 1 THEN list_append(a, array_to_string(hs[i % {ARITY} + 2:], '')) ELSE a END AS a "
                f"FROM {p}w{k} w JOIN {p}r{k} r ON w.g IS NOT DISTINCT FROM r.g AND CASE WHEN w.n > 1 THEN i // {ARITY} ELSE i END = j)"
            )
        parts.append(f"{p}_top AS (SELECT g, h FROM {p}n{levels})")
        parts.append(f"{p}_way AS (SELECT id, b, a FROM {p}w{levels})")

    parts.append("ls AS (SELECT r AS id, lang AS g, i, n, leaf AS h FROM l)")
    tree("t", "ls")
    parts.append("gs AS (SELECT g AS id, 0 AS g, CAST(row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS BIGINT) AS i, count(*) OVER () AS n, h FROM t_top)")
    tree("u", "gs")
    parts.append(
        "f AS (SELECT doc_id, leaf, other, t_top.h AS subroot, u_top.h AS root, list_concat(t_way.b, u_way.b) AS b, list_concat(t_way.a, u_way.a) AS a "
        "FROM l JOIN t_way ON t_way.id = l.r JOIN t_top ON t_top.g IS NOT DISTINCT FROM l.lang JOIN u_way ON u_way.id IS NOT DISTINCT FROM l.lang, u_top)"
    )
    fold = "list_reduce(list_prepend(other, list_transform(generate_series(1, len(b)), lambda i: b[i] || '|' || a[i])), lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2)))"
    proof = "sha256(array_to_string(list_transform(generate_series(1, len(b)), lambda i: b[i] || a[i]), ''))"
    return (
        "WITH " + ", ".join(parts) + f" SELECT doc_id, leaf, subroot, root, {proof} AS proof_sha256, {fold} AS folded_root, {fold} = root AS verified FROM f"
    )


SQL = _sql()
