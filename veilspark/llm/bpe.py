"""Byte-level BPE encoding and decoding with a given rank file.

The ranked merges are a fold of Spark's higher-order functions over the bounds of a word's parts. Beside each word goes a
table of the ranks of its own substrings, so that the rank of two neighbours is one look-up by their bounds, and no plan
holds the rank file.

1. Texts are cut by the vocabulary's pattern, and for every distinct word of the corpus the documents that hold it are
   counted (partial sums before the shuffle).
2. The words of most documents, at most ``DICTIONARY_WORDS`` of them (a histogram of counts finds the limit), are folded
   once each; this bounded dictionary and the rank file are sent to the executors.
3. Texts are cut again. Known words become ids at once; the tables of the few others travel beside the document, are
   folded there by the same expression, and their ids fill the gaps. Nothing is shuffled by document, and the result
   doesn't depend on which words the dictionary holds. A word of one document is folded once in any case.

Python works once in a task: what it makes for a fold is written when it is folded, and read again for the next function.
Two functions in one task are two workers for each core, and all of them live on, with what they took, in later stages.

Decoding concatenates the binary pieces of the ids: one gather from the table of pieces, document by document.
"""

from __future__ import annotations

import base64
import math
import re
import sys
import unicodedata
from functools import cached_property, lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import PORTION, as_bytes, map_batches, materialize, worker_cache

#: Bounds of the dictionary that is sent to the executors: words, and the bytes of a word in it.
DICTIONARY_WORDS = 1 << 19
DICTIONARY_BYTES = 64
#: A pair of parts is one number: its rank in front of so many bits, which hold the bound between the parts.
SHIFT = 31
#: The pattern that is also cut in arrays of characters, all texts of a portion at a time.
CONTRACTED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER, LETTER, NUMBER, SPACE = range(4)
#: Bytes of texts that are cut beside the dictionary at a time: pieces, ids and tables take many times as much.
CUT = PORTION // 4


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """Of each code point, whether it is in \\p{L}, \\p{N}, \\s or none of them."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    major = np.array([unicodedata.category(chr(c))[0] for c in range(len(out))])
    out[major == "L"], out[major == "N"] = LETTER, NUMBER
    # White_Space is str.isspace() without the four information separators.
    out[[c for c in range(len(out)) if chr(c).isspace() and not 0x1C <= c <= 0x1F]] = SPACE
    return out


def starts_of_pieces(chars: np.ndarray, text_ends: np.ndarray) -> np.ndarray:
    """Where the pieces of ``CONTRACTED`` start in the code points of texts that end at ``text_ends``."""
    n = len(chars)
    kind = kinds()[chars]
    first = np.zeros(n + 1, bool)
    first[np.r_[0, text_ends]] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # The last of white space before something else is on its own, or a blank in front of that.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n])
    start[last] = True
    start[last + 1] = chars[last] != ord(" ")
    # A piece that starts with an apostrophe and a letter is a contraction or the apostrophe alone.
    at = np.flatnonzero((chars[:-1] == ord("'")) & start[:-1] & (kind[1:] == LETTER) & ~first[1:n])
    x, y = chars[at + 1], np.where(first[at + 2], 0, chars[np.minimum(at + 2, n - 1)])
    one = np.isin(x, [ord(c) for c in "stmd"])
    two = (np.isin(x, [ord("r"), ord("v")]) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))
    start[at[one | two] + 1] = False
    after = np.r_[at[one] + 2, at[two] + 3]
    start[after[after < n]] = True
    return np.flatnonzero(start)


class Splitter:
    """``pattern`` for the standard library: \\p{L}, \\p{N} and \\s written out as ranges of code points.

    Texts within the basic plane, nearly all, use classes cut off there, which the library looks up in bitmaps.
    """

    def __init__(self, pattern: str):
        self.pattern = pattern
        self.beyond = re.compile("[\U00010000-\U0010ffff]").search

    @cached_property
    def basic(self):
        return _compiled(self.pattern, 0xFFFF).findall

    @cached_property
    def full(self):
        return _compiled(self.pattern, sys.maxunicode).findall

    def findall(self, text: str) -> list[str]:
        return (self.basic if text.isascii() or not self.beyond(text) else self.full)(text)

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts (no nulls) one after the other, and how many there are up to the end of each text."""
        if self.pattern != CONTRACTED:
            found = [self.findall(text) for text in texts.to_pylist()]
            return pa.array([w for words in found for w in words], pa.string()), np.cumsum([0, *map(len, found)])[1:]
        raw, ends = _buffer(texts)
        chars = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4")
        if not len(chars):
            return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
        at = np.flatnonzero((raw & 0xC0) != 0x80)  # the byte of each character
        text_ends = np.searchsorted(at, ends)
        starts = starts_of_pieces(chars, text_ends)
        bounds = np.r_[at[starts], len(raw)].astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(raw))
        return pieces, np.searchsorted(starts, text_ends)


def _buffer(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and where each value ends in them."""
    _, ends, data = values.buffers()
    ends = np.frombuffer(ends, np.int32)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int32)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends[1:] - ends[0]


def _strings(values: pa.Array) -> list[str]:
    """Many short strings, several times as fast as ``to_pylist``."""
    return values.to_numpy(zero_copy_only=False).tolist()


@lru_cache(maxsize=4)
def splitter(pattern: str) -> Splitter:
    return Splitter(pattern)


def _compiled(pattern: str, top: int) -> re.Pattern:
    def ranges(test) -> str:
        out, start = [], None
        for c in range(top + 2):
            if c <= top and test(chr(c)):
                start = c if start is None else start
            elif start is not None:
                out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
                start = None
        return "".join(out)

    letters = ranges(lambda c: unicodedata.category(c)[0] == "L")
    numbers = ranges(lambda c: unicodedata.category(c)[0] == "N")
    # White_Space is str.isspace() without the four information separators.
    spaces = ranges(lambda c: c.isspace() and not "\x1c" <= c <= "\x1f")
    inside = {r"\p{L}": letters, r"\p{N}": numbers, r"\s": spaces}
    out, depth, i = [], 0, 0
    while i < len(pattern):
        for name, chars in inside.items():
            if pattern.startswith(name, i):
                out.append(chars if depth else f"[{chars}]")
                i += len(name)
                break
        else:
            if pattern.startswith(r"\S", i):
                out.append(f"[^{spaces}]")
                i += 2
                continue
            depth += {"[": 1, "]": -1}.get(pattern[i], 0)
            out.append(pattern[i])
            i += 1
    return re.compile("".join(out))


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def prefixes(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """``ranks``, and -1 for beginnings of entries that are no entries themselves."""
    return {piece[:end]: -1 for piece in ranks for end in range(1, len(piece))} | ranks


def rank_tables(words: list[bytes], known: dict[bytes, int]) -> pa.ListArray:
    """For each word the ranks of its substrings, by where they begin and end; ``known``: see ``prefixes``.

    The rank of the substring from i to j is at ``i * step + j``, and step at 0. Rows are as wide as two parts can be, at most
    twice the longest entry in the word, and overlap in nothing, so that a table is linear in the length of a long word.
    """
    begin, end, rank, count, get = [], [], [], [], known.get
    for word in words:
        before, size = len(rank), len(word)
        for i in range(size):
            for j in range(i + 1, size + 1):
                r = get(word[i:j])
                if r is None:
                    break
                if r >= 0:
                    begin.append(i)
                    end.append(j)
                    rank.append(r)
        count.append(len(rank) - before)
    begin, end, count, size = (np.array(x, np.int64) for x in (begin, end, count, list(map(len, words))))
    longest = np.maximum.reduceat(end - begin, np.cumsum(count) - count) if words else count
    step = np.minimum(size, 2 * longest) - 1
    ends = np.cumsum((size - 1) * step + size + 1)
    base = np.r_[0, ends[:-1]] if words else ends
    flat = np.full(ends[-1] if words else 0, -1, np.int32)
    flat[base] = step
    flat[np.repeat(base, count) + begin * np.repeat(step, count) + end] = rank
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(flat, mask=flat < 0))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_word(table: Column) -> Column:
    """Ids of one word: ranked merges as a fold over the bounds of its parts, for words of any length.

    ``table`` is the word's one of ``rank_tables``. Each step ranks the adjacent pairs, finds the smallest, the leftmost of
    equals, and removes the bound inside it. A word without such a pair is marked by its first bound, and left as it is by
    the remaining steps. Words that are in the rank file themselves are not for this fold.
    """
    step = F.get(table, F.lit(0))
    size = ((F.size(table) + step - 1) / (step + 1)).cast("int")
    inside = F.lit((1 << SHIFT) - 1)

    def merge(bounds: Column, _: Column) -> Column:
        pair = lambda x, i: F.shiftleft(F.get(table, x * step + F.get(bounds, i + 2)).cast("long"), SHIFT) + F.get(bounds, i + 1)
        marked = F.concat(F.array(F.lit(-1)), F.slice(bounds, F.lit(2), F.size(bounds)))
        cut = lambda least: F.when(least.isNull(), marked).otherwise(F.array_remove(bounds, least.bitwiseAND(inside).cast("int")))
        return F.when(F.get(bounds, F.lit(0)) < 0, bounds).otherwise(_let(F.array_min(F.transform(bounds, pair)), cut))

    def ids(bounds: Column) -> Column:
        own = lambda x, i: F.get(table, F.greatest(x, F.lit(0)) * step + F.get(bounds, i + 1))
        return F.transform(F.slice(bounds, F.lit(1), F.size(bounds) - 1), own)

    return _let(_let(F.sequence(F.lit(0), size), lambda all_: F.aggregate(F.slice(all_, F.lit(3), F.size(all_)), all_, merge)), ids)


def file_words(ranks: dict[bytes, int]) -> dict[str, int]:
    """Entries of the rank file that are text, with their ids."""
    out = {}
    for piece, rank in ranks.items():
        try:
            out[piece.decode()] = rank
        except UnicodeDecodeError:  # part of a character: never a word
            pass
    return out


def word_counts(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(word, n): in how many texts each word stands, of all words that are no entry of the rank file."""

    def run(batch: pa.RecordBatch):
        pieces, ends = splitter(pattern).cut(batch.column(0))
        coded, own = pieces.dictionary_encode(), shared.value
        at, words = coded.indices.to_numpy(), coded.dictionary
        new = np.fromiter((w not in own for w in _strings(words)), bool, len(words))
        text = np.repeat(np.arange(len(ends)) * len(words), np.diff(ends, prepend=0))
        once = np.sort((text + at)[new[at]])
        n = np.bincount(once[np.diff(once, prepend=-1) > 0] % max(1, len(words)), minlength=len(words))
        yield {"word": words.filter(pa.array(n > 0)), "n": n[n > 0]}

    shared = docs.sparkSession.sparkContext.broadcast(frozenset(file_words(ranks)))
    counted = map_batches(docs.select(F.coalesce("text", F.lit("")).alias("text")), run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _band(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double")) * 4).cast("int")


def dictionary(docs: DataFrame, ranks: dict[bytes, int], pattern: str, most: int = DICTIONARY_WORDS) -> list[tuple[bytes, ...]]:
    """The words of most texts, at most ``most``, with their ids packed as 32-bit integers.

    They come in blocks of (hashes, words, their ends, ids, their ends), flat buffers instead of an object for each word.
    """
    counts = materialize(word_counts(docs, ranks, pattern).where((F.col("n") > 1) & (F.octet_length("word") <= DICTIONARY_BYTES)))
    bands = counts.groupBy(_band(F.col("n")).alias("band")).count().orderBy(F.desc("band")).collect()  # under 256 rows
    total, least = 0, math.inf
    for band, n in bands:
        if (total := total + n) > most:
            break
        least = band
    if least == math.inf:
        return []
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def spelt(batch: pa.RecordBatch):
        words = as_bytes(batch.column(0))
        yield {"word": words, "table": rank_tables(words, _worker_prefixes(shared))}

    def block(batch: pa.RecordBatch):
        words = batch.column(0).to_pylist()
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], "<u8")
        spelt_words = b"".join(words), np.cumsum([0, *map(len, words)])[1:].astype("<i4")
        ids = batch.column(1)
        starts = ids.offsets.to_numpy()
        packed_ids = ids.flatten().to_numpy(zero_copy_only=False).astype("<i4"), (starts[1:] - starts[0]).astype("<i4")
        yield {name: [bytes(buffer)] for name, buffer in zip(BLOCK, (hashes, *spelt_words, *packed_ids))}

    # The few files of counts are dealt anew, as folding is the work.
    chosen = counts.where(_band(F.col("n")) >= least).select("word").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    folded = map_batches(chosen, spelt, "word binary, table array<int>").select("word", fold_word(F.col("table")).alias("ids"))
    packed = map_batches(materialize(folded), block, ", ".join(f"{name} binary" for name in BLOCK))
    rows, blocks = materialize(packed).collect(), []
    while rows:  # each row goes as its block is made, so that the driver holds one copy of the dictionary
        blocks.append(tuple(map(bytes, rows.pop())))
    return blocks


BLOCK = ("hashes", "words", "word_ends", "ids", "id_ends")


#: Stands where a word's ids are yet to come.
GAP = -1


class _Words:
    """Ids by word: a list for each id of the rank file, one for each word of the dictionary, and a gap.

    Words of the dictionary are sorted by their hashes; words are compared themselves.
    """

    def __init__(self, blocks: list[tuple[bytes, ...]], ranks: dict[bytes, int]):
        self.file, self.prefixes, self.words = file_words(ranks), prefixes(ranks), b"".join(b[1] for b in blocks)
        shift = np.cumsum([0, *(len(b[1]) for b in blocks)])
        stop = np.concatenate([*(np.frombuffer(b[2], "<i4") + s for b, s in zip(blocks, shift)), np.zeros(0, np.int64)]).astype(np.int32)
        hashes = np.concatenate([*(np.frombuffer(b[0], "<u8") for b in blocks), np.zeros(0, np.uint64)])
        self.order = np.argsort(hashes)
        self.hashes, self.bounds = hashes[self.order], [x[self.order] for x in (np.r_[np.int32(0), stop[:-1]][: len(stop)], stop)]
        self.first = max(ranks.values()) + 1
        self.gap = self.first + len(hashes)
        sizes = [np.diff(np.frombuffer(b[4], "<i4"), prepend=0) for b in blocks]
        ends = np.cumsum(np.concatenate([[0], np.ones(self.first, np.int64), *sizes, [1]])).astype(np.int32)
        values = np.concatenate([np.arange(self.first, dtype=np.int32), *(np.frombuffer(b[3], "<i4") for b in blocks), np.array([GAP], np.int32)])
        self.lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))

    def look_up(self, words: list[str]) -> np.ndarray:
        """The place of each word in ``lists``."""
        file = self.file.get
        out = np.array([file(w, self.gap) for w in words], np.int64)
        new = np.flatnonzero(out == self.gap)
        if not len(new) or not len(self.hashes):
            return out
        raw = [words[i].encode() for i in new.tolist()]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, raw), np.uint64, len(raw))
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        known = at[hit]
        places = zip(hit.tolist(), *(x[known].tolist() for x in self.bounds))
        same = np.fromiter((self.words[a:b] == raw[i] for i, a, b in places), bool, len(hit))
        out[new[hit[same]]] = self.first + self.order[known[same]]
        return out

    def place(self, pieces: pa.Array, ends: np.ndarray) -> dict[str, pa.Array]:
        """For texts cut into ``pieces``: packed ids with ``GAP`` for unknown words, the numbers of those words among the
        text's unknown ones, and their tables."""
        coded = pieces.dictionary_encode()
        at, words = coded.indices.to_numpy(), _strings(coded.dictionary)
        rows = self.look_up(words)[at]
        ids = self.lists.take(pa.array(rows))
        text = np.arange(len(ends) + 1)
        open_ = np.flatnonzero(rows == self.gap)
        of = np.searchsorted(ends, open_, side="right")
        unknown, word = np.unique(at[open_], return_inverse=True)
        own, number = np.unique(of * max(1, len(unknown)) + word, return_inverse=True)
        first = np.searchsorted(own // max(1, len(unknown)), text)
        tables = rank_tables([words[i].encode() for i in unknown.tolist()], self.prefixes)
        rare = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), tables.take(pa.array(own % max(1, len(unknown)))))
        known = _packed(ids.flatten().to_numpy(zero_copy_only=False), ids.offsets.to_numpy()[np.r_[0, ends]])
        return {"known": known, "gaps": _packed(number - first[of], np.searchsorted(of, text)), "rare": rare}


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Runs of integers, 32 bits each, as a binary column."""
    buffers = [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(values.astype(np.int32).tobytes())]
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, buffers)


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, ends = _buffer(column)
    return raw.view("<i4"), ends // 4


def filled(known: pa.Array, gaps: pa.Array, own: pa.ListArray) -> pa.ListArray:
    """The ids of each text: its known ones, and in each gap those of the list in ``own`` that the gap names."""
    ids, ends = _unpacked(known)
    gap = np.flatnonzero(ids == GAP)
    if not len(gap):
        return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids))
    number, number_ends = _unpacked(gaps)
    lists = own.values.take(pa.array(number + np.repeat(own.offsets.to_numpy()[:-1], np.diff(number_ends, prepend=0))))
    sizes = np.ones(len(ids), np.int64)
    sizes[gap] = new = np.diff(lists.offsets.to_numpy())
    stop = np.cumsum(sizes)
    out = np.full(stop[-1], GAP, np.int32)
    out[(stop - sizes)[ids != GAP]] = ids[ids != GAP]
    out[np.repeat(stop[gap] - np.cumsum(new), new) + np.arange(new.sum())] = lists.flatten().to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, stop][np.r_[0, ends]].astype(np.int32)), pa.array(out))


def placed(docs: DataFrame, rank_path: str, pattern: str, most: int = DICTIONARY_WORDS) -> DataFrame:
    """(doc_id, known, gaps, own), written: what ``filled`` makes each text's ids of."""
    spark, ranks = docs.sparkSession, load_ranks(rank_path)
    known = spark.sparkContext.broadcast(dictionary(docs, ranks, pattern, most))
    shared = spark.sparkContext.broadcast(ranks)

    def run(batch: pa.RecordBatch):
        yield {"doc_id": batch.column(0)} | _worker_words(known, shared).place(*splitter(pattern).cut(batch.column(1)))

    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    cut = map_batches(texts, run, "doc_id long, known binary, gaps binary, rare array<array<int>>", portion=CUT)
    # Packed ids are half zeros, of which Snappy makes little.
    return materialize(cut.select("doc_id", "known", "gaps", F.transform("rare", fold_word).alias("own")), "zstd")


def encode(docs: DataFrame, rank_path: str, pattern: str, most: int = DICTIONARY_WORDS) -> DataFrame:
    """(doc_id, ids array<int>): each text's ids by the rank file, pieces of ``pattern`` separately, no special tokens.

    Null and empty texts have no ids. One row for each row of ``docs``; an empty table gives none. Other columns, and
    repeated or missing doc_ids, are of no account.
    """
    run = lambda b: iter([{"doc_id": b.column(0), "ids": filled(*b.columns[1:])}])
    return map_batches(placed(docs, rank_path, pattern, most), run, "doc_id long, ids array<int>")


#: What a Python worker has built last, with the broadcast value it was built of, which is so kept from being freed.
_CACHE: dict[str, tuple] = worker_cache({})


def _built(kind: str, value, build):
    if kind not in _CACHE or _CACHE[kind][0] is not value:
        _CACHE.clear()
        _CACHE[kind] = value, build()
    return _CACHE[kind][1]


def _worker_words(known, ranks) -> _Words:
    """The dictionary of a Python worker, built once and replaced when another broadcast arrives."""
    return _built("words", known.value, lambda: _Words(known.value, ranks.value))


def _worker_prefixes(ranks) -> dict[bytes, int]:
    return _built("prefixes", ranks.value, lambda: prefixes(ranks.value))


def piece_table(ranks: dict[bytes, int]) -> pa.Array:
    """The binary piece of each id, at its place."""
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pa.array(pieces, pa.binary())


def _joined(table: pa.Array, ids: pa.Array) -> memoryview:
    """Entries of ``table`` for ``ids``, end to end: one gather leaves them so in its buffer."""
    _, ends, data = table.take(ids).buffers()
    end = int(np.frombuffer(ends, np.int32)[len(ids)]) if len(ids) else 0
    return memoryview(data)[:end] if end else memoryview(b"")


def _documents(ids: pa.ListArray) -> list[pa.Array]:
    values, ends = ids.values, ids.offsets.to_pylist()
    return [values.slice(a, b - a) for a, b in zip(ends, ends[1:])]


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, raw binary): the pieces of each row's ``ids``, joined in order. No ids give no bytes."""
    pieces = encoded.sparkSession.sparkContext.broadcast(piece_table(ranks))

    def run(batch: pa.RecordBatch):
        raw = [bytes(_joined(pieces.value, ids)) for ids in _documents(batch.column(1))]
        yield {"doc_id": batch.column(0), "raw": raw}

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, raw binary")


def digests(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row for each row of ``docs``.

    Decodes as ``decode`` does, and hashes each document's bytes where they are joined.
    """
    ranks = load_ranks(rank_path)
    pieces = docs.sparkSession.sparkContext.broadcast(piece_table(ranks))
    decimals = docs.sparkSession.sparkContext.broadcast(pa.array([b"%d," % i for i in range(max(ranks.values()) + 1)], pa.binary()))

    def run(batch: pa.RecordBatch):
        each = _documents(filled(*batch.columns[1:]))
        yield {
            "doc_id": batch.column(0),
            "n_tokens": [len(ids) for ids in each],
            "ids_sha256": [sha256(_joined(decimals.value, ids)[:-1]).hexdigest() for ids in each],
            "decoded_sha256": [sha256(_joined(pieces.value, ids)).hexdigest() for ids in each],
        }

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(placed(docs, rank_path, pattern), run, schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
