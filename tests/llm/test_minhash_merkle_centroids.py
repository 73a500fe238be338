import hashlib
import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from veilspark.llm import centroids, merkle, minhash_dedup


# MinHash near-dedup


def shingle_set(text, k=2):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split(" ") if text else []
    w = [x for part in w for x in part.replace("\t", "\n").replace("\r", "\n").replace("\v", "\n").replace("\f", "\n").split("\n") if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def linked_by_all_pairs(texts):
    sets, up = [shingle_set(t) for t in texts], list(range(len(texts)))
    find = lambda x: x if up[x] == x else find(up[x])
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            up[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def near_texts():
    rng, texts = np.random.default_rng(5), []
    for g in range(30):
        base = [f"g{g}w{x}" for x in rng.integers(0, 400, 120)]
        texts.append(" ".join(base))
        for edits in (1, 2, 4, 5, 6, 7, 9, 30):
            copy = list(base)
            for at in rng.integers(0, 120, edits):
                copy[at] = f"n{rng.integers(1 << 30)}"
            texts.append(" ".join(copy))
    texts += ["Um DOIS", "um\tdois\n", "dois um", "", None, "  \n", "só", "só", "SÓ", "a a a a", "a a", " x y", "x y"]
    return texts + ["longo " * 50_000, "longo longo"]


def test_minhash_equals_all_pairs(spark):
    texts = near_texts()
    roots, sizes = linked_by_all_pairs(texts)
    assert 0 < len(set(roots)) < len(texts) - 100
    docs = spark.createDataFrame([(i, t, -i) for i, t in enumerate(texts)], "doc_id int, text string, set_id int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == {i: (n, root, i == root) for i, (n, root) in enumerate(zip(sizes, roots))}


def test_minhash_chain_in_one_crowd(spark):
    """A crowd of near copies that no single head is similar to all of: links run along a chain."""
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[:40] * 3 + [f"u{i + j}" for j in range(12)] + base[40:]) for i in range(120)] * 2
    roots, _ = linked_by_all_pairs(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs).collect()} == dict(enumerate(roots))


def test_minhash_without_ids_and_rows(spark):
    rows = [(None, "um dois tres"), (4, "um dois tres"), (4, "um dois tres"), (None, "só ele aqui"), (None, None), (7, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in minhash_dedup.near_duplicates(docs).collect())
    assert got == Counter([(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (None, 2, None, True), (None, 0, None, True), (7, 0, 7, True), (9, 0, 9, True)])
    assert minhash_dedup.near_duplicates(docs.limit(0)).isEmpty()


def test_tables_find_pairs_at_the_threshold():
    rng, hit = np.random.default_rng(6), 0
    for _ in range(200):
        x = np.unique(rng.integers(0, 1 << 63, 1200, np.uint64))
        rng.shuffle(x)
        a, b = (minhash_dedup.collections(np.sort(s)) for s in (x[:540], x[60:600]))
        hit += all((a[i] == b[i]).any() for i in (0, 1))
    assert hit >= 198


# Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) level by level, straight from the definition."""
    def leaf(row, text):
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)])

    def climb(nodes):
        proofs, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, p in enumerate(at):
                run = p // 8 * 8
                proofs[i].append((nodes[run:p], nodes[p + 1 : run + 8]))
            nodes, at = [sha(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)], [p // 8 for p in at]
        return nodes[0], proofs

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, ways = climb([trees[g][0] for g in names])
    out = []
    for g, way in zip(names, ways):
        for (_, _, own, r), proof in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            low = r[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
            node = leaf(r, low) if hit else own
            for before, after in proof + way:
                node = sha(*before, node, *after)
            siblings = sha(*[x for before, after in proof + way for x in before + after])
            out.append((r[0], own, trees[g][0], root, siblings, node, node == root))
    return out


@pytest.mark.parametrize("n, rows_per_range", [(1, 5), (9, 5), (700, 13), (700, 100_000)])
def test_manifest_by_definition(spark, n, rows_per_range):
    langs = ["en", None, "de", "çé", ""]
    rows = [(3 * i - 20, None if i % 7 == 0 else "src", langs[min(i % 23, 4)] if i % 3 else "en", None if i % 5 == 0 else i, (None, "", "Texto A", "texto b", "Ção")[i % 5]) for i in range(n)]
    if n > 100:
        rows += [(5, "s", "en", 1, "A"), (5, "s", "en", 1, "A"), (5, "s", "en", 2, "B"), (None, "s", "en", 1, "A"), (None, None, None, None, None), (2**40, "s", "only", 1, "X" * 300_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string")
    got = Counter(map(tuple, merkle.manifest(docs, rows_per_range).collect()))
    assert got == Counter(plain_manifest(rows))
    if n > 100:
        assert 0 < sum(c for r, c in got.items() if not r[-1]) < len(rows)


def test_manifest_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest(docs).count() == 0


# Centroid clustering


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted((sha(f"1:{i}"), v) for i, v in kept if i is not None)
    c = [v for _, v in start[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        c = [[sum(col) // len(own[j]) for col in zip(*own[j])] if j in own else m for j, m in enumerate(c)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], c


def vectors(n):
    rng = np.random.default_rng(8)
    mids = rng.normal(0, 1, (12, 64))
    rows = [(i, [float(x) for x in mids[i % 12] + rng.normal(0, 0.4, 64)]) for i in range(n)]
    rows += [(n + j, [float(j % 2)] * 64) for j in range(20)]  # equal vectors: ties
    return rows + [(9_000, None), (9_001, [1.0] * 63), (9_002, [1.0] * 65), (9_003, [None] + [1.0] * 63), (9_004, [float("nan")] * 64), (9_005, [float("inf")] + [0.0] * 63), (9_006, [])]


@pytest.mark.parametrize("n", [0, 3, 400])
def test_clusters_by_definition(spark, n):
    rows = vectors(n) + [(None, [0.5] * 64), (1, [0.25] * 64), (1, [0.25] * 64)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id int, embedding array<double>, cluster int")
    found, c = centroids.clustered(df)
    want, plain = plain_clusters(rows)
    assert c.tolist() == plain
    assert Counter((r.vec_id, r.cluster, r.distance) for r in found.collect()) == Counter(want)


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame([(None, [0.5] * 64), (1, [0.5] * 3)], "vec_id long, embedding array<double>")
    for part in (df, df.limit(0)):
        found, c = centroids.clustered(part)
        assert found.isEmpty() and len(c) == 0


def test_screening_leaves_out_most_and_never_the_nearest():
    rng = np.random.default_rng(9)
    mids = rng.integers(-200, 200, (16, 64))
    x = mids[rng.integers(0, 16, 3000)] + rng.integers(-20, 20, (3000, 64))
    cluster, distance, exact = centroids.nearest(x, centroids.norms(x), mids, centroids.norms(mids))
    all_ = ((x[:, None] - mids) ** 2).sum(2)
    assert (cluster == all_.argmin(1)).all() and (distance == all_.min(1)).all() and exact.mean() < 3
    assert (centroids.bounds(centroids.norms(x), centroids.norms(mids)) <= all_).all()


def test_components_too_large_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        centroids.clustered(df)
