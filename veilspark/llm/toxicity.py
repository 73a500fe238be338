"""Toxicity by a gap-weighted subsequence kernel, Nyström landmarks and a linear support vector machine.

Words, with marked ends, are compared by their common subsequences of ``ORDER`` symbols spread over at most ``SPAN``
places, each weighted by ``DECAY`` to the power of its spread: inserted characters (``id-iot``) and gaps leave most of
them in place. Runs of single characters (``i d i o t``) are read as one word, and words with separators (``i-d-i-o-t``)
also without them. The landmarks are words of labelled
sentences; the Nyström factor of their own kernel matrix turns a word's similarities into features of a linear machine,
and a text is as toxic as its worst words.

Fitting uses a bounded number of labelled documents; scoring runs over every whole text, one pass without a shuffle.
"""

from __future__ import annotations

import heapq
import itertools
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import as_bytes, map_batches, materialize, portions, short_batches, turn_to, worker_cache

ORDER, SPAN, DECAY = 4, 6, 0.7
#: Hashed space of the subsequences.
DIMS = 1 << 16
LANDMARKS = 256
#: Bound of the fit, in labelled documents; their distinct words, half a KB each in the driver, take part without exception.
MAX_TRAIN = 2000
#: Words of a toxic text that stand for it after the first round.
WITNESSES = 3
#: Margin of a word that isn't there: a clean one's.
NO_WORD = -1.0
#: Weight of clean words against witnesses.
CLEAN = 10.0
#: Words a worker remembers before it starts afresh.
REMEMBER = 100_000
#: Rows that are worked on at a time where a copy is made.
ROWS = 2048
THRESHOLD = 0.7
#: Inside a word, what isn't a letter or digit.
SEPARATORS = re.compile(r"[\W_]+")
SINGLES = re.compile(r"(?<!\S)(?:\S[ \t]+){2,}\S(?!\S)")
#: Offsets of the later symbols of a subsequence.
STEPS = np.array(list(itertools.combinations(range(1, SPAN), ORDER - 1)))
WEIGHTS = DECAY ** (STEPS[:, -1] + 1.0)


def words_of(text: bytes) -> set[str]:
    """Distinct lower-case words, stripped of what isn't a letter or digit at their ends, also without separators."""
    s = text.decode("utf-8", "replace").lower()
    found = set(s.split())
    found.update("".join(m.group().split()) for m in SINGLES.finditer(s))
    found = {w.strip(".,;:!?\"'()[]|%*&$#") for w in found}
    found.update([SEPARATORS.sub("", w) for w in found if not w.isalnum()])
    return found - {""}


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, hashed subsequence, weight) of all words; words have about the same length."""
    n = max(map(len, words)) + 2
    codes = np.zeros((len(words), n + SPAN), np.uint32)
    for i, w in enumerate(words):
        codes[i, 1 : len(w) + 1] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes[i, 0], codes[i, len(w) + 1] = 1, 2
    out_i, out_h, out_w = [], [], []
    for steps, weight in zip(STEPS, WEIGHTS):
        h = codes[:, :n].astype(np.uint64)
        ok = codes[:, :n] > 0
        for s in steps:
            later = codes[:, s : n + s]
            h = h * np.uint64(1_000_003) + later
            ok &= later > 0
        i, at = np.nonzero(ok)
        out_i.append(i)
        out_h.append(((h[i, at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64) & (DIMS - 1))
        out_w.append(np.full(len(i), weight, np.float32))
    return np.concatenate(out_i), np.concatenate(out_h), np.concatenate(out_w)


def _vectors(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse unit vectors (word, dimension, value), each pair once."""
    i, h, w = subsequences(words)
    key = i * DIMS + h
    keys, inverse = np.unique(key, return_inverse=True)
    value = np.bincount(inverse, w, len(keys))
    i, h = keys // DIMS, keys % DIMS
    norm = np.sqrt(np.bincount(i, value**2, len(words)))
    return i, h, (value / np.maximum(norm[i], 1e-12)).astype(np.float32)


def similarities(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel of each word with each landmark, both of unit length: a product of two sparse matrices."""
    i, h, v = _vectors(landmarks)
    order = np.argsort(h, kind="stable")
    mark, value, n_marks = i[order], v[order], len(landmarks)
    count = np.bincount(h, minlength=DIMS)
    start = np.cumsum(count) - count
    out = np.zeros((len(words), n_marks), np.float32)
    for part, rows in _parts(words):
        i, h, v = _vectors(part)
        n = count[h]
        at = np.arange(n.sum()) + np.repeat(start[h] - np.cumsum(n) + n, n)
        cells = np.repeat(i, n) * n_marks + mark[at]
        out[rows] = np.bincount(cells, np.repeat(v, n) * value[at], len(part) * n_marks).reshape(-1, n_marks)
    return out


def _parts(words: list[str], most: int = 4096, symbols: int = 1 << 16):
    """Portions of words of about the same length, with their places; a very long word stands alone."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and end - at < most and (end - at + 1) * (len(words[order[end]]) + 2) <= symbols:
            end += 1
        rows = order[at:end]
        yield [words[i] for i in rows], rows
        at = end


class Scorer:
    """Margins of words; a linear machine on kernel values is one weight for each subsequence."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: float):
        i, h, v = _vectors(landmarks)
        self.table = np.bincount(h, v * weights[i], DIMS).astype(np.float32)
        self.bias = bias
        self.known: dict[str, float] = {}

    def learn(self, words: list[str]) -> None:
        for part, _ in _parts(words):
            i, h, v = _vectors(part)
            margin = np.bincount(i, self.table[h] * v, len(part)) + self.bias
            self.known.update(zip(part, margin.tolist()))

    def top(self, texts: list[set[str]]) -> np.ndarray:
        """The two largest margins of each text's words; where there are fewer, a clean word's stand for them."""
        if len(self.known) > REMEMBER:
            self.known.clear()
        new = set().union(*texts) - self.known.keys()
        if new:
            self.learn(list(new))
        known = self.known.__getitem__
        return np.array([(heapq.nlargest(2, map(known, words)) + [NO_WORD] * 2)[:2] for words in texts]).reshape(-1, 2)


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray
    bias: float
    curve: np.ndarray

    def scorer(self) -> Scorer:
        return Scorer(self.landmarks, self.weights, self.bias)

    def scores(self, top: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(top @ self.curve[:2] + self.curve[2], -30, 30)))


def choose_landmarks(bad: dict[str, int], good: dict[str, int], n_bad: int, n_good: int, most: int = LANDMARKS) -> list[str]:
    """Words of labelled texts: those that tell most about toxic texts, the clean words most like them, and others."""
    told = sorted(((n / n_bad) / ((good.get(w, 0) + 1) / n_good), n, w) for w, n in bad.items() if n >= 3 and len(w) >= 3)[::-1]
    chosen = [w for r, _, w in told if r > 3][: most // 2]
    clean = sorted((w for w, n in good.items() if n >= 2 and n / n_good >= bad.get(w, 0) / n_bad), key=lambda w: (zlib.crc32(w.encode("utf-8", "surrogatepass")), w))
    like = []
    if chosen and clean:
        near = np.concatenate([similarities(clean[at : at + ROWS], chosen).max(axis=1) for at in range(0, len(clean), ROWS)])
        like = [clean[i] for i in np.argsort(-near, kind="stable")[: most // 4]]
    rest = [w for w in clean if w not in set(like)]
    return (chosen + like + rest[: most - len(chosen) - len(like)]) or ["toxic"]


def _margins(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    weights = w[:-1].astype(np.float32)
    return np.concatenate([z[at : at + ROWS].astype(np.float32) @ weights for at in range(0, len(z), ROWS)]) + np.float32(w[-1])


def _machine(z: np.ndarray, bad: np.ndarray, good: np.ndarray, c: float, steps: int = 12) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton steps over its support vectors.

    Each row of ``z`` may stand on both sides: ``bad`` is its cost as an example above, ``good`` as one below zero.
    """
    n = z.shape[1] + 1
    w, before = np.zeros(n), None
    for _ in range(steps):
        margin = _margins(z, w)
        inside = (bad > 0) & (margin < 1), (good > 0) & (margin > -1)
        if before is not None and all((a == b).all() for a, b in zip(inside, before)):
            break
        before = inside
        up, down = np.where(inside[0], bad, 0), np.where(inside[1], good, 0)
        a, b, some = c * np.diag(np.r_[np.ones(n - 1), 1e-3]), np.zeros(n), np.flatnonzero(up + down)
        for at in range(0, len(some), ROWS):
            part = some[at : at + ROWS]
            rows = np.c_[z[part].astype(np.float32), np.ones(len(part), np.float32)]
            a += (rows * (up + down)[part, None].astype(np.float32)).T @ rows
            b += rows.T @ (up - down)[part].astype(np.float32)
        w = np.linalg.solve(a, b)
    return w[:-1], float(w[-1])


def fit(texts: list[bytes], labels: list[int], landmarks: int = LANDMARKS, c: float = 1e-5, rounds: int = 3) -> Model:
    return fit_words([sorted(words_of(t)) for t in texts], labels, landmarks, c, rounds)


def fit_words(docs: Iterable[list[str]], labels: Iterable[int], landmarks: int = LANDMARKS, c: float = 1e-5, rounds: int = 3) -> Model:
    """Fits word margins so that a toxic text's best words are above and all words of clean texts below zero.

    ``docs``: the distinct words of each text. The first round takes every word of a toxic text for an example of its
    label; the next ones only the words that score best in their text. A logistic curve turns a text's two largest
    margins into its score. Without texts of both labels every text gets one and the same score.
    """
    number: dict[str, int] = {}
    rows = [np.array([number.setdefault(w, len(number)) for w in words], np.int32) for words in docs]  # 4 bytes a word
    y = np.array(list(labels), int)
    n_bad, n_good = int(y.sum()), int(len(y) - y.sum())
    if not n_bad or not n_good or not number:
        return Model(["toxic"], np.zeros(1), -1.0, np.array([0.0, 0.0, -4.0 if not n_bad else 4.0 if not n_good else 0.0]))
    words, size = list(number), len(number)
    n_in = [sum((np.bincount(r, minlength=size) for r, label in zip(rows, y) if label == k), np.zeros(size, int)) for k in (1, 0)]
    bad, good = ({w: int(n) for w, n in zip(words, counts) if n} for counts in n_in)
    marks = choose_landmarks(bad, good, n_bad, n_good, landmarks)
    own = similarities(marks, marks)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    factor = (vectors * np.maximum(values, 1e-2) ** -0.5).astype(np.float32)
    z = np.concatenate([(similarities(words[at : at + ROWS], marks) @ factor).astype(np.float16) for at in range(0, size, ROWS)])
    above, below = n_in[0] / n_bad, n_in[1] / n_good
    for r in range(rounds):
        w, b = _machine(z, above / above.sum(), below / below.sum() * (CLEAN if r else 1), c)
        margins = _margins(z, np.r_[w, b])
        if r + 1 < rounds:  # witnesses of toxic texts
            above = np.zeros(size)
            for row, label in zip(rows, y):
                if label:
                    above[row[np.argsort(-margins[row], kind="stable")[:WITNESSES]]] += 1
            if not above.sum():
                break
    best = [np.sort(np.r_[margins[row], NO_WORD, NO_WORD])[-2:][::-1] if len(row) < 2 else np.sort(margins[row])[-2:][::-1] for row in rows]
    top = np.c_[np.array(best), np.ones(len(rows))]
    scale = np.abs(top[:, :2]).mean() + 1e-9
    x, curve = top / np.array([scale, scale, 1]), np.zeros(3)
    for _ in range(100):  # Newton steps of a logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) / len(x) + 1e-4 * np.eye(3)
        curve = curve + np.linalg.solve(h, x.T @ (y - p) / len(x) - 1e-4 * curve)
    return Model(marks, factor.astype(float) @ w, b, curve / np.array([scale, scale, 1]))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    """Fits on at most ``most`` labelled documents outside the held-out third, taken in the order of a hash of doc_id.

    Texts are reduced to their distinct words where they are read; only those reach the driver. Labels that are null or
    without doc_id don't count; of several labels of one document the largest does.
    """
    ids = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    ids = ids.where(~held_out(F.col("label_id"))).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    sample = ids.orderBy(F.xxhash64("label_id"), "label_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))

    def run(batch: pa.RecordBatch):
        words = [" ".join(sorted(words_of(t))).encode("utf-8", "replace") for t in as_bytes(batch.column(0))]
        yield {"words": words, "toxic": batch.column(1)}

    # Written first, so that all executors take part; the driver then reads the files one after the other.
    got = materialize(map_batches(rows.select("text", "toxic"), run, "words binary, toxic int")).toLocalIterator()
    packed = sorted((zlib.crc32(r.words), bytes(r.words), r.toxic) for r in got)  # the same fit in any order
    return fit_words((w.decode().split() for _, w, _ in packed), [y for _, _, y in packed])


_SCORERS: dict[int, Scorer] = worker_cache({})


def _scores(model: Model, texts: list[bytes]) -> np.ndarray:
    """Scores of texts in a Python worker, which keeps some words of its model from batch to batch."""
    if id(model) not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[id(model)] = model.scorer()
    scorer, out = _SCORERS[id(model)], [np.zeros(0)]
    for at in range(0, len(texts), 256):
        out.append(model.scores(scorer.top([words_of(t) for t in texts[at : at + 256]])))
    return np.concatenate(out)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of ``docs``: probability that the text is toxic, from the whole text alone.

    Null and empty texts have no words and get the score of clean words; repeated rows get equal scores, whatever their
    doc_ids. An empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        yield {"doc_id": batch.column(0), "score": _scores(shared.value, as_bytes(batch.column(1)))}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double")


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with all their columns.

    Whole Arrow batches are scored and thinned out where they stand: nothing is shuffled, and no text is copied between
    Spark and Python row by row. Null and empty texts are clean, repeated rows share one fate, rows without doc_id are
    judged like others; without usable labels every row stays.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")
    short_batches(docs.sparkSession)
    stage = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(stage)
        for batch in batches:
            for part in portions(batch):
                yield part.filter(pa.array(_scores(shared.value, as_bytes(part.column(at))) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
