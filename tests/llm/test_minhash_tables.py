"""Table keys, buckets and incremental contraction of the MinHash operator, by definition."""

from itertools import product

import numpy as np
from pyspark.sql import functions as F

from veilspark.llm import minhash_dedup as m


def test_only_shared_parts_are_paired(spark):
    sets = {1: ([11, 12], [21, 22]), 2: ([11, 13], [21, 23]), 3: ([11, 14], [24, 25]), 4: ([15, 16], [26, 27])}
    rows = spark.createDataFrame([(s, 5, a, b) for s, (a, b) in sets.items()], "set_id long, n long, a array<long>, b array<long>")
    got = sorted((r.key, r.set_id) for r in m.table_keys(rows).collect())
    pair = F.xxhash64(F.col("x"), F.col("y"))
    keys = {s: {(x, y) for x, y in product(a, b)} for s, (a, b) in sets.items()}
    both = [(x, y, s) for s in sets for x, y in keys[s] if any((x, y) in keys[o] for o in sets if o != s)]
    expect = spark.createDataFrame(both, "x long, y long, set_id long").select(pair.alias("key"), "set_id").collect()
    assert set(got) == {(r.key, r.set_id) for r in expect} and len(got) == len(set(got))


def test_equal_buckets_count_once_and_single_members_go(spark):
    rows = [(1, s) for s in (7, 8)] + [(2, s) for s in (8, 7)] + [(3, s) for s in (7, 8, 9)] + [(4, 9)]
    keyed = spark.createDataFrame([(k, s, 5) for k, s in rows], "key long, set_id long, n long")
    got = sorted((r.key, r.set_id) for r in m.buckets(keyed).collect())
    assert got == [(1, 7), (1, 8), (3, 7), (3, 8), (3, 9)]


def test_later_links_join_roots(spark):
    edges = lambda *e: spark.createDataFrame(e, "a long, b long")
    roots = m.joined(m.joined(None, edges((1, 2), (3, 4), (5, 6))), edges((2, 4), (7, 8), (6, 5)))
    found = {r.v: r.root for r in roots.collect()}
    groups = {frozenset(v for v in found if found[v] == r) for r in found.values()}
    assert groups == {frozenset({1, 2, 3, 4}), frozenset({5, 6}), frozenset({7, 8})} and roots.count() == 8


def test_no_tables(spark):
    none = spark.createDataFrame([], "set_id long, n long, a array<long>, b array<long>")
    assert m.buckets(m.table_keys(none)).isEmpty()


def test_bitmaps_never_pass_over_a_link():
    rng = np.random.default_rng(9)
    for n in (1, 2, 9, 40, 300, 3000):
        for _ in range(60):
            x = np.unique(rng.integers(0, 1 << 63, 2 * n, np.uint64))
            both = rng.integers(0, n + 1)
            a, b = x[:n], x[n - both : 2 * n - both]
            apart = int(np.bitwise_count((m.parity(a) ^ m.parity(b)).view(np.uint64)).sum())
            assert apart <= len(np.setxor1d(a, b))


def test_unlike_members_of_a_bucket_give_no_rows(spark, monkeypatch):
    """A bucket of 60 sets, each pair at a similarity of a half, and two links: only the links reach the whole sets."""
    common = [f"c{i}" for i in range(100)]
    texts = [" ".join(common + [f"u{s}x{i}" for i in range(50)]) for s in range(60)]
    texts += [texts[3] + " fim", texts[7] + " fim"]
    rows = spark.createDataFrame(list(enumerate(texts)), "set_id long, text string")
    sets = m.found_sets(rows)
    assert sets.count() == len(texts)
    seen, confirmed = [], m.confirmed
    monkeypatch.setattr(m, "confirmed", lambda pairs, *more: seen.extend(map(tuple, pairs.collect())) or confirmed(pairs, *more))
    members = sets.select(F.lit(1).cast("long").alias("key"), "set_id", F.size("found").cast("long").alias("n"))
    roots = {r.v: r.root for r in m.linked(members, lambda wanted: sets).collect()}
    assert roots[3] == roots[60] and roots[7] == roots[61] and len(set(roots.values())) == 2
    assert sorted(seen) == [(3, 60), (7, 61)]


def test_roots_are_looked_up_once_a_set(spark, monkeypatch):
    """A set in 40 buckets is one row of the join with roots, not 40, and keeps all of its buckets."""
    members = spark.range(40 * 30).selectExpr("id % 40 as key", "id div 40 as set_id", "7L as n")
    roots = spark.createDataFrame([(s, s % 3) for s in range(20)], "v long, root long")
    plans, materialize = [], m.materialize
    monkeypatch.setattr(m, "materialize", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or materialize(df))
    got = m.with_roots(members, roots)
    assert {tuple(r) for r in got.collect()} == {(k, s, 7, s % 3 if s < 20 else s) for k in range(40) for s in range(30)} and got.count() == 1200
    (plan,) = plans
    assert plan.index("Generate explode") < plan.index("Join LeftOuter") < plan.index("Aggregate [set_id")


def test_parts_of_one_component_are_not_laid_out(spark):
    """Parts that only linked sets have give no table keys; those that another component has too give all of theirs."""
    sets = [(1, [11, 12], [21, 22], 1), (2, [11, 12], [21, 22], 1), (3, [12, 13], [22, 23], 3)]
    rows = spark.createDataFrame([(s, 5, a, b, r) for s, a, b, r in sets], "set_id long, n long, a array<long>, b array<long>, root long")
    assert m.table_keys(rows.where("root = 1")).isEmpty()
    key = spark.range(1).select(F.xxhash64(F.lit(12).cast("long"), F.lit(22).cast("long"))).first()[0]
    assert {tuple(r) for r in m.table_keys(rows).collect()} == {(key, 1, 5, 1), (key, 2, 5, 1), (key, 3, 5, 3)}


def test_near_copies_are_not_laid_out_again(spark, monkeypatch):
    """120 near copies beside one set that is too far from them: no round lays out their memberships in 144 tables again."""
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 1 << 30, 200)]
    texts = [" ".join(base[:at] + [f"n{at}"] + base[at + 1 :]) for at in range(0, 120)]
    far = list(base)
    for at in range(0, 200, 12):
        far[at] = f"f{at}"
    docs = spark.createDataFrame(list(enumerate([*texts, " ".join(far)])), "doc_id long, text string")
    laid, with_roots = [], m.with_roots
    monkeypatch.setattr(m, "with_roots", lambda *a: laid.append(with_roots(*a)) or laid[-1])
    got = {r.doc_id: r.component_id for r in m.near_duplicates(docs).collect()}
    assert got == {i: 0 if i < 120 else 120 for i in range(121)}
    assert sum(x.count() for x in laid) <= 12 * 121
