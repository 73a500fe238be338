"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

1. All word n-grams of an item are its seeds. Rarity doesn't choose among them, as an item's own leaks make the n-grams
   common that edited copies keep.
2. Training texts are cut into overlapping passages; a passage with a seed is a candidate for the seed's items, unless
   it holds too few of an item's words for any alignment to pass.
3. Each distinct pair of passage and item is aligned word by word (match, mismatch and gap scores); an item leaks into a
   document if its best local alignment covers enough of it.

The benchmark is a query set of its own size. It is taken in blocks, so that what travels to the executors is bounded.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import ROW, as_bytes, keyed, map_batches, materialize

N = 3
#: Items of one block; their n-grams are sent to the executors.
BLOCK_ITEMS = 20_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of the perfect score from which an item leaks, and share of its words that must match.
SCORE, COVER = 0.5, 0.6
#: Passages overlap by their half; alignment sees whole items, as a passage is widened by the item's length.
STRIDE = 128
EDGES = re.compile(rb"^[^0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff]+$")


def words_of(text: bytes) -> list[bytes]:
    """White-space words, A-Z lower-cased, ASCII punctuation stripped at their ends."""
    return [x for w in text.lower().split() if (x := w if w.isalnum() else EDGES.sub(b"", w))]


def item_seeds(words: list[bytes], n: int = N) -> set[tuple[bytes, ...]]:
    """Every n-gram of an item, however common its leaks have made it; a shorter item's whole word sequence."""
    return set(zip(*(words[i:] for i in range(n)))) if len(words) >= n else {tuple(words)} - {()}


def passages(docs: DataFrame, texts: dict[int, list[bytes]], n: int = N) -> DataFrame:
    """(doc_id, at, passage, items): passages with a seed, widened by the longest item on both sides.

    ``items`` are those that share a seed and enough single words; an alignment can't match more words than are there.
    """
    longest = max(map(len, texts.values()), default=0)
    holders: dict[tuple[bytes, ...], tuple[int, ...]] = {}
    for item, w in texts.items():
        for g in item_seeds(w, n):
            holders[g] = (*holders.get(g, ()), item)
    bags = {item: (COVER * len(w), list(Counter(w).items())) for item, w in texts.items()}
    shared = docs.sparkSession.sparkContext.broadcast((holders, bags, sorted({len(g) for g in holders})))

    def run(batch: pa.RecordBatch):
        known, bags, lengths = shared.value
        out: dict[str, list] = {"doc_id": [], "at": [], "passage": [], "items": []}
        for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            w = words_of(text)
            found = defaultdict(set)
            for size in lengths:
                rolled = list(zip(*(w[i:] for i in range(size))))
                if known.keys().isdisjoint(rolled):
                    continue
                for i, g in enumerate(rolled):
                    if g in known:
                        found[i // STRIDE].update(known[g])
            for part, items in found.items():
                start = max(0, part * STRIDE - longest)
                words = w[start : (part + 1) * STRIDE + n + longest]
                there = Counter(words).get
                items = [x for x in items if sum(min(c, there(v, 0)) for v, c in bags[x][1]) >= bags[x][0]]
                if items:
                    out["doc_id"].append(doc)
                    out["at"].append(start)
                    out["passage"].append(b" ".join(words).decode("utf-8", "replace"))
                    out["items"].append(items)
        yield out

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, at long, passage string, items array<long>")


def align(passage: list[str], item: list[str]) -> tuple[int, int, int, int]:
    """(score, matched words, first word, last word) of the best local alignment of two word lists."""
    index: dict[str, int] = {}
    a = np.array([index.setdefault(w, len(index)) for w in passage], np.int64)
    b = [index.setdefault(w, len(index)) for w in item]
    n = len(a)
    score, matched, begin = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), np.arange(n + 1)
    steps, best = np.arange(n + 1), (0, 0, 0, -1)
    for word in b:
        same = a == word
        diag = score[:-1] + np.where(same, MATCH, MISMATCH)
        up = score[1:] + GAP
        h = np.zeros(n + 1, np.int64)
        h[1:] = np.maximum(0, np.maximum(diag, up))
        m, s = np.zeros(n + 1, np.int64), np.arange(n + 1)
        take = (h[1:] > 0) & (diag >= up)
        m[1:] = np.where(take, matched[:-1] + same, np.where(h[1:] > 0, matched[1:], 0))
        s[1:] = np.where(take, begin[:-1], np.where(h[1:] > 0, begin[1:], steps[1:]))
        # Gaps in the item: the best score to the left, less one for each word skipped.
        lead = h - GAP * steps
        source = np.maximum.accumulate(np.where(lead == np.maximum.accumulate(lead), steps, 0))
        slid = h[source] + GAP * (steps - source)
        better = slid > h
        h, m, s = np.where(better, slid, h), np.where(better, m[source], m), np.where(better, s[source], s)
        top = int(h.argmax())
        if h[top] > best[0]:
            best = (int(h[top]), int(m[top]), int(s[top]), top - 1)
        score, matched, begin = h, m, s
    return best


def _block(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).collect()
    texts = {r.item_id: words_of(bytes(r.text)) for r in rows}
    found = materialize(passages(docs, texts, n))
    pairs = found.select(F.md5("passage").alias("of"), F.explode("items").alias("item_id")).distinct()
    unique = found.select(F.md5("passage").alias("of"), "passage").groupBy("of").agg(F.first("passage").alias("passage"))
    known = docs.sparkSession.sparkContext.broadcast({k: [x.decode("utf-8", "replace") for x in w] for k, w in texts.items()})

    def run(batch: pa.RecordBatch):
        out: dict[str, list] = {c: [] for c in ("of", "item_id", "score", "cover", "first", "last")}
        for of, item, passage in zip(*(c.to_pylist() for c in batch.columns)):
            w = known.value[item]
            score, matched, first, last = align(passage.split(" "), w)
            if score >= SCORE * MATCH * len(w) and matched >= COVER * len(w):
                for c, v in zip(out, (of, item, score / (MATCH * len(w)), matched / len(w), first, last)):
                    out[c].append(v)
        yield out

    asked = pairs.join(unique, "of").select("of", "item_id", "passage")
    good = materialize(map_batches(asked, run, "of string, item_id long, score double, cover double, first long, last long"))
    where = found.select("doc_id", "at", F.md5("passage").alias("of"))
    return where.join(good, "of").groupBy("doc_id", "item_id").agg(
        F.max(F.struct("score", "cover", (F.col("at") + F.col("first")).alias("first_word"), (F.col("at") + F.col("last")).alias("last_word"))).alias("best")
    ).select("doc_id", "item_id", "best.*")


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = N, block: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, score, cover, first_word, last_word): test items found in training documents, best place each.

    ``score`` is the alignment's share of a perfect copy's, ``cover`` the share of the item's words that match; words
    count from 0. Null and empty texts on either side match nothing; items of fewer than ``n`` words match
    where their whole word sequence stands. Repeated rows of ``docs`` add nothing; rows without doc_id are reported under
    null. Without items or documents there are no rows. Items must have distinct ids; other columns are ignored.
    """
    items = benchmark.where("item_id is not null").select("item_id", "text").groupBy("item_id").agg(F.min("text").alias("text"))
    total = items.count()
    parts = max(1, -(-total // block))
    numbered = items.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)))
    found = [_block(docs, numbered.where(F.col("part") == p), n) for p in range(parts)]
    return reduce(DataFrame.unionByName, found)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a leaked test item, with all their columns."""
    rows = keyed(docs)
    bad = materialize(leaks(rows.select(F.col(ROW).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(ROW)).distinct())
    return rows.join(bad, ROW, "left_anti").select(docs.columns)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
