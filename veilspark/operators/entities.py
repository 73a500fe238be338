"""Entity sources and filters. Entities are four array columns: nomes, locais, estabelecimentos, vulgos."""

from __future__ import annotations

import re
import time
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.lexicons import (
    BRANDS_EXCLUDED, CATEGORIES, KINSHIP, NAMES_EXCLUDED, PLACEHOLDER_WORDS, PLACES_EXCLUDED, RAW_LABELS,
)
from veilspark.functions.textnorm import chunks, normalized
from veilspark.sources.staging import stage

CATS = [c for c, _, _ in CATEGORIES]
TEXTS = "array<string>"
WORD = "[0-9A-Za-zÀ-ÿ]+"


def no_entities() -> Column:
    return F.array().cast(TEXTS)


def source_none(df: DataFrame) -> DataFrame:
    """Adds empty entity columns: detectors only."""
    return df.select("*", *[no_entities().alias(c) for c in CATS])


def with_entities(df: DataFrame, found: DataFrame, key: str = "seq") -> DataFrame:
    """Adds entities from a long table (key, category, idx, entity), in the order of idx; records without any get empty ones."""
    lists = [
        F.transform(F.array_sort(F.collect_list(F.when(F.col("category") == c, F.struct("idx", "entity")))), lambda x: x["entity"]).alias(c)
        for c in CATS
    ]
    by_key = found.groupBy(F.col(key).alias("__key")).agg(*lists)
    joined = df.join(by_key, df[key] == by_key["__key"], "left")
    return joined.select(*[df[c] for c in df.columns], *[F.coalesce(by_key[c], no_entities()).alias(c) for c in CATS])


def source_stored(df: DataFrame, mentions: DataFrame, key: str = "seq") -> DataFrame:
    """Adds entities that an earlier run stored."""
    return with_entities(df, mentions, key)


#: Dictionaries up to so many terms and characters are sent to every executor as a trie; larger ones are joined.
TRIE_TERMS, TRIE_CHARS = 200_000, 8_000_000
FOLDS = {c: "".join(x for x in unicodedata.normalize("NFKD", chr(c).lower()) if x.isalnum()) for c in range(0x100)}


def term_words(term: Column) -> Column:
    """The words of a dictionary term, each normalised, joined by one space: what a trie or a join compares."""
    return F.array_join(F.transform(F.regexp_extract_all(term, F.lit(WORD), F.lit(0)), normalized), " ")


class Trie:
    """Dictionary terms by their normalised words; one pass over a text's words finds all of them, overlapping ones too."""

    def __init__(self, terms: list[tuple[str, str]]):
        self.root: dict = {}
        for category, words in terms:
            node = self.root
            for w in words.split(" "):
                node = node.setdefault(w, {})
            node.setdefault(None, []).append(category)

    def find(self, text: str) -> list[tuple[int, str, str]]:
        """(place of the first word, entity as it stands, category), by place, then length; words stand one space apart."""
        out, begun, last = [], [], -1
        for i, m in enumerate(re.finditer(WORD, text)):
            if m.start() != last + 1 or text[last] != " ":
                begun = []
            word, last = m.group().translate(FOLDS), m.end()
            begun = [(place, start, node[word]) for place, start, node in [*begun, (i, m.start(), self.root)] if word in node]
            out += [(place, text[start:last], c) for place, start, node in begun for c in node.get(None, ())]
        return sorted(out, key=lambda x: (x[0], len(x[1])))


def _trie_column(trie: Trie, text: Column) -> Column:
    """struct of the four categories found in ``text``, row by row, without a key."""

    @F.arrow_udf("struct<" + ", ".join(f"{c}: array<struct<idx: int, entity: string>>" for c in CATS) + ">")
    def find(texts: pa.Array) -> pa.Array:
        found = [trie.find(t.as_py() or "") for t in texts]
        kind = pa.list_(pa.struct([("idx", pa.int32()), ("entity", pa.string())]))
        lists = [pa.array([[{"idx": i, "entity": e} for i, e, k in row if k == c] for row in found], kind) for c in CATS]
        return pa.StructArray.from_arrays(lists, names=CATS)

    # Not to be moved into a later source's lambda functions, where no Python function can run.
    return find.asNondeterministic()(text)


def ngrams(text: Column, most: int) -> Column:
    """array<struct<pos,gram,norm>>: runs of up to ``most`` words that stand one space apart, in time linear in the text."""
    words, gaps = F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.split(text, WORD, -1)
    shift = lambda a, n: F.slice(a, n + 1, F.size(a))
    norms = F.transform(words, normalized)
    at = F.transform(words, lambda _, i: i)
    # Arrays are shifted once for a text; the function below sees only one word and those after it.
    parts = [at, words, norms] + [shift(a, n) for n in range(1, most) for a in (words, norms, gaps)]
    zipped = F.arrays_zip(*[p.alias(f"c{i}") for i, p in enumerate(parts)])

    def runs(x: Column) -> Column:
        get = lambda i: x[f"c{i}"]
        gram, norm, fits, out = get(1), get(2), get(0).isNotNull(), []
        for n in range(most):
            if n:
                w, v, gap = (get(3 * n + k) for k in range(3))
                fits = fits & w.isNotNull() & (gap == " ")
                gram, norm = F.concat(gram, F.lit(" "), w), F.concat(norm, F.lit(" "), v)
            out.append(F.when(fits, F.struct(get(0).alias("pos"), gram.alias("gram"), norm.alias("norm"))))
        return F.array(*out)

    return F.filter(F.flatten(F.transform(zipped, runs)), lambda g: g.isNotNull())


def small_dictionary(terms: DataFrame) -> list[tuple[str, str]] | None:
    """The terms (category, normalised words) if they are few and short enough to be sent to every executor, else none."""
    known = terms.select("category", term_words(F.col("term")).alias("words")).where("words <> ''").distinct()
    size = known.agg(F.count("*"), F.sum(F.length("words"))).first()
    if size[0] > TRIE_TERMS or (size[1] or 0) > TRIE_CHARS:
        return None
    return sorted(map(tuple, known.collect()))


def _joined_hits(rows: DataFrame, terms: DataFrame, text: str, key: str, most: int) -> DataFrame:
    """(key, category, idx, entity) by an equi-join of word runs with terms: for dictionaries of any size."""
    runs = rows.select(key, F.explode(ngrams(F.col(text), most)).alias("g")).select(key, "g.pos", "g.gram", "g.norm")
    known = terms.select("category", term_words(F.col("term")).alias("norm")).where("norm <> ''").distinct()
    return runs.join(known, "norm").select(key, "category", F.col("pos").alias("idx"), F.col("gram").alias("entity"))


def _with_lists(df: DataFrame, terms: DataFrame, text: str, most: int) -> DataFrame:
    """``df`` with the categories as arrays of (idx, entity): by a trie, or beyond its limits by a join on a row number."""
    few = small_dictionary(terms)
    if few is not None:
        trie = Trie([(c, w) for c, w in few if w.count(" ") < most])
        return df.withColumn("__found", _trie_column(trie, F.col(text))).select("*", *[F.col(f"__found.{c}").alias(f"__{c}") for c in CATS]).drop("__found")
    rows = stage(df.withColumn("__row", F.monotonically_increasing_id()))
    lists = [F.array_sort(F.collect_list(F.when(F.col("category") == c, F.struct("idx", "entity")))).alias(f"__{c}") for c in CATS]
    found = _joined_hits(rows, terms, text, "__row", most).groupBy("__row").agg(*lists)
    none = F.array().cast("array<struct<idx:int,entity:string>>")
    return rows.join(found, "__row", "left").select(*df.columns, *[F.coalesce(f"__{c}", none).alias(f"__{c}") for c in CATS])


def _named(category: str) -> Column:
    """The hits of one category as array<struct<category,idx,entity>>."""
    return F.transform(f"__{category}", lambda x: F.struct(F.lit(category).alias("category"), x["idx"].alias("idx"), x["entity"].alias("entity")))


def gazetteer_hits(df: DataFrame, terms: DataFrame, text: str, key: str = "seq", most: int = 3) -> DataFrame:
    """(key, category, idx, entity): dictionary terms (category, term) of up to ``most`` words that stand in the text.

    Whole words in any case and with or without accents, one space apart. Rows are independent, so repeated and null keys
    are safe; null texts hold nothing.
    """
    found = _with_lists(df.select(key, text), terms, text, most)
    each = F.explode(F.concat(*[_named(c) for c in CATS]))
    return found.select(key, each.alias("x")).select(key, "x.category", "x.idx", "x.entity")


def source_gazetteer(df: DataFrame, terms: DataFrame, text: str = "stage1_text", most: int = 3) -> DataFrame:
    """Adds the dictionary's entities to each row, in the order of the text."""
    found = _with_lists(df, terms, text, most)
    return found.select(*df.columns, *[F.transform(f"__{c}", lambda x: x["entity"]).alias(c) for c in CATS])


COSTS = {"latency_s": "double", "prompt_tokens": "int", "completion_tokens": "int"}
Model = Callable[[list[str]], list[dict]]


def _model_column(load: Callable[[], Model], text: Column) -> Column:
    """struct of the four categories and the costs that a user's model gives for ``text``, row by row."""
    schema = ", ".join([*[f"{c}: {TEXTS}" for c in CATS], *[f"{c}: {t}" for c, t in COSTS.items()]])

    @F.pandas_udf(f"struct<{schema}>")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for texts in batches:
            asked = [i for i, t in enumerate(texts) if isinstance(t, str) and t.strip()]
            began = time.perf_counter()
            got = dict(zip(asked, model([texts.iloc[i] for i in asked]) if asked else []))
            share = (time.perf_counter() - began) / max(1, len(asked))
            rows = [got.get(i, {}) for i in range(len(texts))]
            lists = {c: [list(x.get(c) or []) for x in rows] for c in CATS}
            costs = {
                "latency_s": [float(x.get("latency_s", share)) if i in got else 0.0 for i, x in enumerate(rows)],
                **{c: [int(x.get(c) or 0) for x in rows] for c in ("prompt_tokens", "completion_tokens")},
            }
            yield pd.DataFrame(lists | costs)

    return ask.asNondeterministic()(text)  # as in _trie_column


def _total(values: Column, kind: str) -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, x: (a + x).cast(kind))


def source_model(df: DataFrame, load: Callable[[], Model], text: str = "stage1_text", limit: int | None = None) -> DataFrame:
    """Adds entities and costs (latency_s, prompt_tokens, completion_tokens) from a user's batch model.

    ``load`` runs once in each worker and returns texts -> list of dicts: entities by category and, if known, the costs;
    without a latency of its own a text has an even share of its batch's time. Blank texts are not sent to the model: no
    entities, no costs. Results belong to rows, so repeated and null keys are safe.

    ``limit``: longest text that the model takes. Longer ones are sent in blocks of whole sentences, dealt anew over all
    tasks, so that a very long text keeps no single task busy; a record gets the entities of its blocks in their order
    and the sum of their costs.
    """
    names = [*CATS, *COSTS]
    own = [c for c in df.columns if c not in names]
    if limit is None:
        return df.withColumn("__got", _model_column(load, F.col(text))).select(*own, *[F.col(f"__got.{c}").alias(c) for c in names])
    rows = stage(df.withColumn("__row", F.monotonically_increasing_id()))
    blocks = rows.where(F.col(text).isNotNull()).select("__row", F.posexplode(chunks(F.col(text), limit)).alias("__block", "__text"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written: the model's answers are asked for once.
    asked = stage(blocks.repartition(parts).withColumn("__got", _model_column(load, F.col("__text"))).select("__row", "__block", "__got"))
    got = asked.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("__block", "__got"))).alias("__all"))
    of_blocks = lambda c: F.transform("__all", lambda x: x["__got"][c])
    lists = [F.flatten(of_blocks(c)).alias(c) for c in CATS]
    sums = [_total(of_blocks(c), t).alias(c) for c, t in COSTS.items()]
    joined = rows.join(got.select("__row", *lists, *sums), "__row", "left")
    zero = {c: F.lit(0).cast(t) for c, t in COSTS.items()}
    return joined.select(*own, *[F.coalesce(c, no_entities()).alias(c) for c in CATS], *[F.coalesce(c, zero[c]).alias(c) for c in COSTS])


def map_labels(found: DataFrame, label: str = "raw_label") -> DataFrame:
    """Replaces a model's raw label by its category; B-/I- prefixes are cut off, unknown labels dropped."""
    table = F.create_map(*[F.lit(x) for pair in RAW_LABELS.items() for x in pair])
    category = F.element_at(table, F.upper(F.regexp_extract(label, "[^-]+$", 0)))
    return found.withColumn("category", category).where("category is not null").drop(label)


def _listed(s: Column, *lists: list[str]) -> Column:
    return F.array_contains(F.array(*[F.lit(x) for words in lists for x in dict.fromkeys(words)]), F.lower(s))


def is_placeholder(s: Column) -> Column:
    return s.contains("[") | s.contains("]") | F.upper(F.trim(s)).isin(*PLACEHOLDER_WORDS)


def _small_word(s: Column) -> Column:
    return ~s.contains(" ") & s.rlike(r"(?U)^\p{Lower}")


def keep_entity(category: str, s: Column) -> Column:
    """Whether the filter keeps a trimmed entity."""
    drop = is_placeholder(s) | (F.length(s) < 2)
    if category == "nomes":
        kin = F.lit(False)
        for p in KINSHIP:
            kin = kin | s.rlike("(?iU)" + p)
        return ~(drop | kin | _listed(s, NAMES_EXCLUDED, BRANDS_EXCLUDED))
    if category == "vulgos":
        return ~(drop | _listed(s, NAMES_EXCLUDED))
    brands = [BRANDS_EXCLUDED] if category == "estabelecimentos" else []
    return ~(drop | _listed(s, PLACES_EXCLUDED, *brands) | _small_word(s))


def filtered(category: str, entities: Column) -> Column:
    return F.filter(F.transform(entities, lambda s: F.trim(s)), lambda s: keep_entity(category, s))


def filter_entities(df: DataFrame, removed: str | None = None) -> DataFrame:
    """Filters the four entity columns; ``removed`` names a column for the number that fell away."""
    n = sum((F.size(c) - F.size(filtered(c, F.col(c))) for c in CATS), F.lit(0))
    others = [F.col(c) for c in df.columns if c not in CATS]
    return df.select(*others, *[filtered(c, F.col(c)).alias(c) for c in CATS], *([n.alias(removed)] if removed else []))


def only_present(df: DataFrame, text: str) -> DataFrame:
    """Keeps entities whose norm occurs in the text's norm."""
    norm = normalized(F.col(text))
    own = [F.filter(c, lambda x: (normalized(x) != "") & F.contains(F.col("__norm"), normalized(x))).alias(c) for c in CATS]
    others = [c for c in df.columns if c not in CATS]
    return df.withColumn("__norm", norm).select(*others, *own)


def united(a: Column, b: Column) -> Column:
    """Both lists without repeats of a norm; the first spelling stays, in order."""
    pairs = F.transform(F.concat(a, b), lambda x: F.struct(normalized(x).alias("norm"), x.alias("orig")))
    start = F.array().cast("array<struct<norm:string,orig:string>>")

    def add(seen: Column, x: Column) -> Column:
        old = (x["norm"] == "") | F.exists(seen, lambda e: e["norm"] == x["norm"])
        return F.when(old, seen).otherwise(F.concat(seen, F.array(x)))

    return F.aggregate(pairs, start, add, lambda seen: F.transform(seen, lambda e: e["orig"]))
