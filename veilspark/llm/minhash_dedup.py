"""MinHash near-duplicates with tensored banding.

A document's set of word shingles gives two small collections of keys, twelve each, every key a hash of three minima. The
144 table keys are the pairs of a key of the first collection and one of the second: 72 minima do the work of 864. A pair
of sets of similarity 0.8 misses all tables once in about 2,800 times, one of 0.85 once in 46,000.

Equal sets are one from the start. The twelve tables of keys of equal number come first, with few heads, and link most of a
group of near copies. Of the 144 tables, only keys are laid out that several of the components so found may share: a key all
of whose sets are linked already can't add a link. Tables settle in rounds. In each, a few heads of a bucket are compared to those of
its members that are in another component so far; full sets decide. Links are contracted to components, heads that are
done leave, and a bucket is over when its members are of one component. So a bucket of thousands of copies costs one pass
from one head, and no link between members of a bucket is lost.

Members that cannot be linked are passed over inside the join that lets them meet: a set has a parity bitmap, in which each
of its shingles flips one bit. Two bitmaps differ in no more bits than the sets differ in shingles, and linked sets differ
in at most a ninth of their sizes' sum. So what is passed over is never a link, and mutually unlike members of a large
bucket give no rows.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import as_bytes, map_batches, materialize, sent_if_few, worker_cache
from veilspark.llm.components import connected_components

SHINGLE = 2
#: Links have 100 * intersection >= SIMILAR * union.
SIMILAR = 80
COLLECTION, WIDTH = 12, 3
SEED = 42
#: Shingles that are multiplied by all factors at a time.
CHUNK = 1 << 9
#: Each round has so many times the heads of the one before.
GROWTH = 16
#: Rounds of the first tables, which need not find all links: the others hold the same keys and leave none out.
FIRST_ROUNDS = 2
#: Heads to begin with once most links are known: what stays apart in a bucket is mostly unlike, and is done in one round.
MANY = 256
#: 64-bit words of a set's parity bitmap.
PARITY = 16
#: Words whose hashes a worker keeps (4 MB); with more it was no faster.
WORDS = 1 << 15
FACTOR = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.default_rng(SEED)
FACTORS = _random.integers(0, 1 << 63, 2 * COLLECTION * WIDTH, np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _random.integers(0, 1 << 63, 2 * COLLECTION * WIDTH, np.uint64)


class _Words(dict):
    """Hashes of words seen so far, forgotten when there are ``WORDS`` of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, SEED)
        return value


_words = worker_cache(_Words())


def shingles(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles (A-Z lower-cased, ASCII white space); fewer words: one shingle; none: none.

    A shingle's hash is a polynomial of its words' 64-bit hashes, so words are hashed once and shingles made in arrays.
    """
    words = text.lower().split()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(k, len(h))
    out = np.full(max(0, len(h) - k + 1) if k else 0, k, np.uint64)
    for i in range(k):
        out = out * FACTOR + h[i : len(h) - k + 1 + i]
    out.sort()
    return out[np.diff(out, prepend=out[:1] ^ np.uint64(1)) != 0]


def parity(found: np.ndarray) -> np.ndarray:
    """The set's bitmap, ``PARITY`` signed words: a bit is 1 if an odd number of its shingles fall on it."""
    # The upper bits of a product depend on all bits of a shingle's hash.
    at = (found * FACTOR) >> np.uint64(64 - (64 * PARITY).bit_length() + 1)
    bits = np.bincount(at.astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def may_link(similar: int = SIMILAR) -> Column:
    """False only for rows (n, p0, p1, ...; m, q0, q1, ...) whose sets of sizes n and m cannot be linked.

    A link has 100 * (n + m - d) >= similar * (n + m + d), where d shingles are in one of the sets only.
    """
    apart = reduce(add, [F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"q{i}"))) for i in range(PARITY)])
    sizes = 100 * F.least("n", "m") >= similar * F.greatest("n", "m")
    return sizes & ((100 + similar) * apart <= (100 - similar) * (F.col("n") + F.col("m")))


def collections(found: np.ndarray) -> np.ndarray:
    """Two rows of ``COLLECTION`` signed keys, each a hash of its number and ``WIDTH`` minima."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), CHUNK):
        np.minimum(least, (FACTORS[:, None] * found[at : at + CHUNK] + TERMS[:, None]).min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(-1, WIDTH))]
    return np.array(keys, np.uint64).view(np.int64).reshape(2, COLLECTION)


def signatures(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, text_id, set_id, n, a, b): hashes of text and set, the set's size, the two collections."""
    schema = "doc_id long, text_id long, set_id long, n long, a array<long>, b array<long>"

    def run(batch: pa.RecordBatch):
        out: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
        for doc, text, text_id in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist()):
            found = shingles(text, k)
            a, b = collections(found).tolist() if len(found) else ([], [])
            set_id = int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))
            for c, v in zip(out, (doc, text_id, set_id, len(found), a, b)):
                out[c].append(v)
        yield out

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")), run, schema)


def _root(rows: DataFrame) -> Column:
    """The known component of a row's set; without one, each set is its own."""
    return F.col("root" if "root" in rows.columns else "set_id").alias("root")


def first_keys(sets: DataFrame) -> DataFrame:
    """(key, set_id, n): of the 144 table keys, those of two parts with equal numbers."""
    keys = F.transform(F.arrays_zip("a", "b"), lambda x: F.xxhash64(x["a"], x["b"]))
    return sets.select(F.explode(keys).alias("key"), "set_id", "n")


def table_keys(sets: DataFrame) -> DataFrame:
    """(key, set_id, n, root): a row for each pair of a key of the first collection and one of the second.

    ``sets`` may have a ``root``, the component that is known of a set. Several components can only share a table key if they
    share both of its parts, so parts that a single component has are left out before pairing: 24 rows a set are shuffled
    instead of 144.
    """
    half = F.size("a")
    parts = sets.select("set_id", "n", _root(sets), half.alias("half"), F.posexplode(F.concat("a", "b")).alias("at", "part"))
    shared = parts.groupBy("part").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("part")
    live = parts.join(shared, "part").groupBy("set_id", "n", "root")
    live = live.agg(F.collect_list(F.when(F.expr("at < half"), F.col("part"))).alias("a"), F.collect_list(F.when(F.expr("at >= half"), F.col("part"))).alias("b"))
    pairs = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.xxhash64(x, y))))
    return live.select(F.explode(pairs).alias("key"), "set_id", "n", "root")


def buckets(keyed: DataFrame) -> DataFrame:
    """The rows of ``keyed`` (key, set_id, n) in buckets of several components; of buckets with the same members, one is kept.

    Members are compared by their number and 128 bits of hashes, which add up before the shuffle in any order.
    """
    salted = F.xxhash64("set_id", F.lit("second"))
    ends = F.min(_root(keyed)).alias("lo"), F.max(_root(keyed)).alias("hi")
    of = keyed.groupBy("key").agg(F.count("*").alias("c"), *ends, F.bit_xor(F.xxhash64("set_id")).alias("x"), F.bit_xor(salted).alias("y"))
    kept = of.where("lo <> hi").groupBy("c", "x", "y").agg(F.min("key").alias("key")).select("key")
    return keyed.join(kept, "key")


def whole_sets(docs: DataFrame, signed: DataFrame, wanted: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(set_id, found, p0, p1, ...): shingle hashes and bitmap of the sets in ``wanted`` (set_id), each from one text that has it."""
    wanted = materialize(wanted)
    texts = signed.join(sent_if_few(wanted), "set_id", "left_semi")
    texts = materialize(texts.groupBy("set_id").agg(F.min(F.struct("text_id", "doc_id")).alias("t")).select("set_id", "t.*"))
    named = docs.select(F.col("doc_id").cast("long").alias("d"), "text", F.xxhash64("text").alias("h"))
    same = (F.col("h") == F.col("text_id")) & F.col("d").eqNullSafe(F.col("doc_id"))
    return found_sets(named.join(sent_if_few(texts), same), k)


def found_sets(texts: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(set_id, found, p0, p1, ...), one row for each set id of ``texts`` (set_id, text): shingle hashes and bitmap."""

    def run(batch: pa.RecordBatch):
        found = [shingles(t, k) for t in as_bytes(batch.column(1))]
        marks = np.array([parity(x) for x in found], np.int64).reshape(len(found), PARITY)
        yield {"set_id": batch.column(0), "found": [x.view(np.int64) for x in found]} | {f"p{i}": marks[:, i] for i in range(PARITY)}

    schema = ", ".join(["set_id long, found array<long>", *[f"p{i} long" for i in range(PARITY)]])
    return materialize(map_batches(texts.select("set_id", "text"), run, schema).dropDuplicates(["set_id"]))


def confirmed(pairs: DataFrame, sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar; ``sets``: set_id, found."""
    x = sets.select(F.col("set_id").alias("a"), F.col("found").alias("x"))
    y = sets.select(F.col("set_id").alias("b"), F.col("found").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(x, "a").join(y, "b").where(100 * both >= similar * (F.size("x") + F.size("y") - both)).select("a", "b")


def joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(v, root) after more links (a, b). Only the links are contracted, between the roots that there are so far."""
    if roots is None:
        return materialize(connected_components(links))
    at = [roots.select(F.col("v").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab"]
    between = links.join(at[0], "a", "left").join(at[1], "b", "left")
    between = between.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    moved = connected_components(between)
    to = moved.select(F.col("v").alias("old"), F.col("root").alias("new"))
    known = roots.join(to, F.col("root") == F.col("old"), "left").select("v", F.coalesce("new", "root").alias("root"))
    return materialize(known.unionByName(moved.join(roots, "v", "left_anti")))


def with_roots(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` (key, set_id, n) with each set's root, which is looked up once for a set, whatever number of buckets it is in."""
    each = members.groupBy("set_id").agg(F.first("n").alias("n"), F.collect_list("key").alias("keys"))
    own = F.coalesce("root", "set_id").alias("root")
    rooted = each.join(roots, F.col("set_id") == F.col("v"), "left").select("keys", "set_id", "n", own)
    return materialize(rooted.select(F.explode("keys").alias("key"), "set_id", "n", "root"))


def linked(members: DataFrame, fetch, similar: int = SIMILAR, roots: DataFrame | None = None, heads: int = 1, rounds: int | None = None) -> DataFrame:
    """(v, root) of the sets in ``members`` (key, set_id, n) that have links. ``fetch``: wanted set ids -> whole sets.

    ``roots`` (v, root): links that are known before; ``members`` may have them as ``root`` already. ``heads``: heads of a
    bucket in the first round. With ``rounds``, links may be left to a later call.
    """
    sets, tried = None, None
    marks = [f"p{i}" for i in range(PARITY)]
    if "root" not in members.columns:
        members = members.withColumn("root", F.col("set_id")) if roots is None else with_roots(members, roots)
    while True:
        each = members.groupBy("key", "root").agg(F.min("set_id").alias("first"), F.count("*").alias("c"))
        of = each.groupBy("key").agg(F.max(F.struct("c", "root")).alias("most"), F.min("first").alias("first"), F.sum("c").alias("size"), F.count("*").alias("roots"))
        # Buckets of several components.
        of = of.where("roots > 1").select("key", "first", "size", F.col("most.root").alias("most"), (F.col("size") - F.col("most.c")).alias("others"))
        open_ = materialize(members.join(of, "key"))
        if open_.isEmpty():
            return roots if roots is not None else open_.select(F.col("set_id").alias("v"), "root")
        if sets is None:  # whatever later rounds compare is among the first one's
            sets = fetch(open_.select("set_id").distinct())
        share = F.pmod(F.xxhash64("set_id"), F.lit(1 << 20)) / (1 << 20)
        is_head = (F.col("set_id") == F.col("first")) if heads == 1 else (share * F.col("size") < heads)
        # Links that are left in a bucket have an end outside its largest component; few such members are done at once.
        is_head = F.when(F.col("others") <= heads, F.col("root") != F.col("most")).otherwise(is_head)
        open_ = open_.withColumn("head", is_head)
        marked = open_.join(sets.select("set_id", *marks), "set_id")
        h = marked.where("head").select("key", F.col("set_id").alias("a"), F.col("n").alias("m"), F.col("root").alias("other"), *[F.col(c).alias(f"q{c[1:]}") for c in marks])
        met = marked.join(h, "key").where("root <> other and not (head and set_id < a)").where(may_link(similar))
        pairs = met.select(F.least("a", "set_id").alias("a"), F.greatest("a", "set_id").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs)
        found = materialize(confirmed(pairs, sets, similar))
        tried = pairs if tried is None else tried.unionByName(pairs)
        if roots is None or not found.isEmpty():
            roots = joined(roots, found)
        rounds = rounds and rounds - 1
        if rounds == 0:
            return roots
        # Buckets whose smaller components were all heads are over.
        left = open_.where(~F.col("head") & (F.col("others") > heads))
        members = with_roots(left.select("key", "set_id", "n"), roots)
        heads *= GROWTH


def near_duplicates(docs: DataFrame, k: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links. Texts without words (null, empty, white space) have no
    shingles and are linked with nothing, not even each other. Rows without doc_id take part in linking but are never a
    component's id, unless it has no other rows: then it is null, and they count as kept. Rows that share a doc_id are rows
    of their own; repeated rows get equal results. An empty table gives no rows; other columns are ignored.
    """
    signed = materialize(signatures(docs, k))
    some = signed.where("n > 0")
    sets = materialize(some.groupBy("set_id").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("n", "a", "b")).alias("s")).select("set_id", "first_id", "s.*"))
    fetch = lambda wanted: whole_sets(docs, signed, wanted, k)
    roots = linked(materialize(buckets(materialize(first_keys(sets)))), fetch, similar, rounds=FIRST_ROUNDS)
    known = sets.join(roots, F.col("set_id") == F.col("v"), "left").select("set_id", "n", "a", "b", F.coalesce("root", "set_id").alias("root"))
    members = materialize(buckets(materialize(table_keys(known))))
    roots = linked(members, fetch, similar, roots, MANY)
    rooted = materialize(sets.join(roots, F.col("set_id") == F.col("v"), "left").select("set_id", "first_id", F.coalesce("root", "set_id").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    final = materialize(rooted.join(least, "root").select(F.col("set_id").alias("own"), "component_id"))
    out = signed.join(final, (F.col("set_id") == F.col("own")) & (F.col("n") > 0), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
