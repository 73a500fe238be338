"""Registered queries of the de-identification library and their oracle SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import detectors as dt
from veilspark.functions import textnorm as tn
from veilspark.functions.lexicons import BRANDS_EXCLUDED, CATEGORIES, NAMES_EXCLUDED, PLACEHOLDER_WORDS, PLACES_EXCLUDED
from veilspark.jobs import anonymize as job
from veilspark.jobs import oracle as o
from veilspark.operators import bootstrap as bs
from veilspark.operators import entities as ent
from veilspark.operators import redact as rd
from veilspark.operators import score as sc
from veilspark.operators import utility as ut
from veilspark.sources import io
from veilspark.sources import narratives as nv

REPLICATES = 200
CONFIGS = ["regex_only", "gazetteer", "union"]
QUERIES: dict = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "scores_by_type"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


# Shared steps


def narr(s: SparkSession, d: str) -> DataFrame:
    return nv.narratives(s, d)


def docs(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("seq"), "text")


def detected(s: SparkSession, d: str) -> DataFrame:
    return io.stage(dt.stage1(narr(s, d).select("seq", "text")))


def terms(s: SparkSession) -> DataFrame:
    return s.createDataFrame(nv.gazetteer_terms(), "category string, term string")


def gaz(s: SparkSession):
    return partial(ent.source_gazetteer, terms=terms(s))


def mem(s: SparkSession, d: str):
    """Stored mentions, as far as they stand in the text at hand."""
    return lambda df: ent.only_present(ent.source_stored(df, nv.mentions(s, d)), "stage1_text")


def versions() -> dict:
    """Each configuration's entities in the columns of ``records``."""
    return {
        "regex_only": {c: ent.no_entities() for c in ent.CATS},
        "gazetteer": {c: F.col(f"gazetteer.{c}") for c in ent.CATS},
        "union": {c: F.col(f"union.{c}") for c in ent.CATS},
    }


def records(s: SparkSession, d: str) -> DataFrame:
    """One row per record: one pass of the detectors and one look-up per source give the entities of all configurations."""
    first = ent.filter_entities(gaz(s)(detected(s, d))).withColumnsRenamed({c: f"g_{c}" for c in ent.CATS})
    both = ent.filter_entities(ent.source_stored(first, nv.mentions(s, d)))
    listed = F.struct(*[F.col(f"g_{c}").alias(c) for c in ent.CATS])
    union = F.struct(*[ent.united(F.col(f"g_{c}"), F.col(c)).alias(c) for c in ent.CATS])
    return both.select("seq", "text", "stage1_text", "captures", listed.alias("gazetteer"), union.alias("union"))


def outputs(s: SparkSession, d: str, found: DataFrame | None = None) -> DataFrame:
    """Three configurations, one row per record and config."""
    found = io.stage(records(s, d)) if found is None else found
    rows = F.array(*[F.struct(F.lit(k).alias("config"), *[v[c].alias(c) for c in ent.CATS]) for k, v in versions().items()])
    return found.select("seq", "text", "stage1_text", "captures", F.explode(rows).alias("v")).select("v.config", "seq", "text", "stage1_text", "captures", *[f"v.{c}" for c in ent.CATS])


def pairs(s: SparkSession, d: str, found: DataFrame | None = None) -> DataFrame:
    """``found``: the records, where a query uses them more than once."""
    return sc.matched_versions(records(s, d) if found is None else found, versions(), sc.gold_arrays(narr(s, d)))


def stats(s: SparkSession, d: str, found: DataFrame | None = None) -> DataFrame:
    return sc.record_stats(pairs(s, d, found))


def sums(s: SparkSession, d: str, found: DataFrame | None = None) -> DataFrame:
    return sc.totals(stats(s, d, found))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Detectors, one by one, on raw text

for _d in dt.DETECTORS:

    def _detect(s, d, det=_d):
        p = nv.probes(s, d).withColumn("found", dt.spans(F.col("text"), det)).where(F.size("found") > 0)
        return p.select("seq", F.size("found").cast("long").alias("hits"), F.get("found", F.lit(0)).alias("first_span"), F.md5(dt.replaced(F.col("text"), det)).alias("redacted_md5"))

    _p = o.pattern(_d)
    query(
        f"detect_{_d.code}_{_d.label.lower()}",
        f"SELECT seq, len(regexp_extract_all(text, {_p}, 0)) AS hits, regexp_extract(text, {_p}, 0) AS first_span, "
        f"md5(regexp_replace(text, {_p}, '[{_d.label}]', 'g')) AS redacted_md5 FROM ({nv.PROBES}) WHERE regexp_matches(text, {_p})",
    )(_detect)

# Stage 1

_PROBE_CHAIN = o.chain(nv.PROBES)
_NARR_CHAIN = o.chain(f"SELECT seq, text FROM ({nv.NARRATIVES})")
_DOC_CHAIN = o.chain("SELECT doc_id AS seq, text FROM documents")


@query("stage1_probes", f"WITH {_PROBE_CHAIN} SELECT seq, t AS stage1_text FROM s1")
def _(s, d):
    return dt.stage1(nv.probes(s, d)).select("seq", "stage1_text")


@query("stage1_text", f"WITH {_NARR_CHAIN} SELECT seq, t AS stage1_text FROM s1")
def _(s, d):
    return dt.stage1(narr(s, d).select("seq", "text")).select("seq", "stage1_text")


_CAPS = o.captured()


@query("stage1_captures", f"WITH {_PROBE_CHAIN}, {_CAPS} SELECT seq, label, string_agg(span, '|' ORDER BY code, i) AS spans FROM caps GROUP BY seq, label")
def _(s, d):
    found = io.stage(dt.stage1(nv.probes(s, d))).select("seq", F.explode("captures").alias("label", "found"))
    return found.select("seq", "label", F.array_join("found", "|").alias("spans"))


@query("detector_report", f"WITH {_NARR_CHAIN}, {_CAPS} SELECT label, count(*) AS spans, count(DISTINCT seq) AS records FROM caps GROUP BY label")
def _(s, d):
    return dt.label_hits(detected(s, d))


@query("documents_report")
def _(s, d):
    """Detectors on whole documents in four languages; Unicode boundaries put this beyond the other engine's patterns."""
    return dt.label_hits(dt.stage1(docs(s, d)))


@query("law_protection", f"WITH {_NARR_CHAIN} SELECT seq, array_to_string(laws, '|') AS laws, array_to_string(arts, '|') AS articles, contains(t, 'lei 11.343/2006') AS kept FROM s1 WHERE len(laws) > 0 OR len(arts) > 0")
def _(s, d):
    one = detected(s, d)
    laws = F.regexp_extract_all("text", F.lit("(?iU)" + dt.law_pattern()), F.lit(0))
    arts = F.regexp_extract_all("text", F.lit("(?iU)" + dt.article_pattern()), F.lit(0))
    return one.select("seq", F.array_join(laws, "|").alias("laws"), F.array_join(arts, "|").alias("articles"), F.contains("stage1_text", F.lit("lei 11.343/2006")).alias("kept")).where("laws <> '' or articles <> ''")


_REPEATED = "seq, 'x [CPF] [CPF]  [CPF]' || repeat(' ', CAST(seq % 4 AS INT)) || '[URL] [URL]' || repeat(' [RG]', CAST(seq % 3 AS INT)) AS r"


@query("collapse_duplicates", f"SELECT seq, regexp_replace(regexp_replace(r, '(\\[CPF\\])(\\s*\\[CPF\\])+', '[CPF]', 'g'), '(\\[RG\\])(\\s*\\[RG\\])+', '[RG]', 'g') AS collapsed FROM (SELECT {_REPEATED} FROM ({nv.PROBES}))")
def _(s, d):
    return nv.probes(s, d).selectExpr(*[x for x in ("seq", _REPEATED.split(", ", 1)[1])]).select("seq", dt.collapse(F.col("r")).alias("collapsed"))


@query("squeeze_spaces", f"SELECT seq, regexp_replace(replace(text, ' ', repeat(' ', CAST(1 + seq % 4 AS INT))), '  +', ' ', 'g') AS squeezed FROM ({nv.PROBES})")
def _(s, d):
    wide = nv.probes(s, d).selectExpr("seq", "replace(text, ' ', repeat(' ', CAST(1 + seq % 4 AS INT))) AS w")
    return wide.select("seq", dt.squeeze(F.col("w")).alias("squeezed"))


@query("redact_table_column", f"WITH {_PROBE_CHAIN} SELECT seq, text, t AS \"text [anonimizado]\" FROM s1")
def _(s, d):
    return dt.redact_column(nv.probes(s, d), "text")


@query("records_with_label", f"WITH {_PROBE_CHAIN}, {_CAPS} SELECT seq, string_agg(span, '|' ORDER BY code, i) AS spans FROM caps WHERE label = 'COORDENADA' GROUP BY seq")
def _(s, d):
    return dt.records_with_label(io.stage(dt.stage1(nv.probes(s, d))), "COORDENADA").select("seq", F.array_join("spans", "|").alias("spans"))


# Text functions


@query("normalize_text", f"SELECT doc_id, md5({o.norm('text')}) AS norm_md5 FROM documents WHERE NOT regexp_matches(text, '[^\\x00-\\x7F]')")
def _(s, d):
    plain = s.read.parquet(f"{d}/documents.parquet").where(~F.col("text").rlike(r"[^\x00-\x7F]"))
    return plain.select("doc_id", F.md5(tn.normalized(F.col("text"))).alias("norm_md5"))


@query("normalize_text_all")
def _(s, d):
    """All documents, also those that the oracle of ``normalize_text`` leaves out; tested against plain Python."""
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(tn.normalized(F.col("text"))).alias("norm_md5"))


@query("normalize_exact_agrees", "SELECT lang, count(*) AS n, 0::BIGINT AS differing FROM documents GROUP BY lang")
def _(s, d):
    """The built-in normalisation against the exact one, on whole documents in all languages."""
    both = s.read.parquet(f"{d}/documents.parquet").select("lang", tn.normalized(F.col("text")).alias("a"), tn.normalized_exact(F.col("text")).alias("b"))
    return both.groupBy("lang").agg(F.count("*").alias("n"), F.sum((F.col("a") != F.col("b")).cast("long")).alias("differing"))


@query("placeholder_counts", f"WITH {_NARR_CHAIN} SELECT seq, {o.placeholder_count('t')} AS placeholders, length(regexp_replace(t, '\\[[A-Z_]+\\d*\\]', '', 'g')) AS kept_chars FROM s1")
def _(s, d):
    return detected(s, d).select("seq", tn.placeholder_count(F.col("stage1_text")).cast("long").alias("placeholders"), tn.kept_length(F.col("stage1_text")).cast("long").alias("kept_chars"))


@query("chunk_texts")
def _(s, d):
    cut = docs(s, d).select("seq", F.posexplode(tn.chunks(F.col("text"))).alias("block", "piece"))
    return cut.select("seq", "block", F.length("piece").alias("n_chars"), F.md5("piece").alias("piece_md5"))


_ANSWER = (
    "CASE CAST(seq % 4 AS INT) WHEN 0 THEN '<think>{}</think>```json ' || j || ' ```' WHEN 1 THEN 'Resposta: ' || j || ' fim' "
    "WHEN 2 THEN '{\"nomes\": [\"Ana\"' ELSE j END AS answer FROM (SELECT k AS seq, '{\"nomes\": [\"P' || CAST(k AS STRING) || ' \", 7, \"\"], \"locais\": \"L' || CAST(k AS STRING) || '\", \"outros\": [1]}' AS j "
    "FROM (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders) b) a"
)


@query("parse_model_answer", "SELECT k AS seq, CASE WHEN k % 4 <> 2 THEN 'P' || CAST(k AS VARCHAR) END AS nomes, CASE WHEN k % 4 <> 2 THEN 'L' || CAST(k AS VARCHAR) END AS locais, k % 4 <> 2 AS parsed FROM (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders)")
def _(s, d):
    orders = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey")
    orders.createOrReplaceTempView("veilspark_orders")
    raw = s.sql("SELECT seq, " + _ANSWER.replace("FROM orders", "FROM veilspark_orders"))
    p = raw.select("seq", tn.parse_answer(F.col("answer")).alias("p"))
    return p.select("seq", F.get("p.nomes", F.lit(0)).alias("nomes"), F.get("p.locais", F.lit(0)).alias("locais"), F.col("p").isNotNull().alias("parsed"))


# Entity sources and filters

_WORDS = {
    "nomes": ["Ana Souza", "Autor 1", "meu primo", "ex-marido", "PLACA", "iPhone", "Vítima", "X", "autor 12", "segundo suspeito", "Costa"],
    "locais": ["Vila Aurora", "rua", "centro", "Hospital", "[CEP]", "Y", "praia grande", "Jardim"],
    "estabelecimentos": ["Bar do Jorge", "Honda", "mercado", "loja azul", "padoca", "Shopping"],
    "vulgos": ["Tigrao", "autor", "Z", "VULGO", "Dona"],
}


def _word_sql(cat: str) -> str:
    w = _WORDS[cat]
    return "CASE CAST(k % " + str(len(w)) + " AS INT) " + " ".join(f"WHEN {i} THEN {o.q(x)}" for i, x in enumerate(w)) + " END"


def _lower_list(*lists) -> str:
    return "(" + ", ".join(o.q(x) for words in lists for x in dict.fromkeys(words)) + ")"


_TOKEN = f"(contains(e, '[') OR contains(e, ']') OR upper(trim(e)) IN {_lower_list(PLACEHOLDER_WORDS)} OR length(e) < 2)"
_KIN = " OR ".join(f"regexp_matches(e, {o.q('(?i)' + p)})" for p in ent.KINSHIP)
_SMALL = "(NOT contains(e, ' ') AND regexp_matches(e, '^[a-zà-ÿ]'))"
_DROPS = {
    "nomes": f"{_TOKEN} OR {_KIN} OR lower(e) IN {_lower_list(NAMES_EXCLUDED, BRANDS_EXCLUDED)}",
    "locais": f"{_TOKEN} OR {_SMALL} OR lower(e) IN {_lower_list(PLACES_EXCLUDED)}",
    "estabelecimentos": f"{_TOKEN} OR {_SMALL} OR lower(e) IN {_lower_list(PLACES_EXCLUDED, BRANDS_EXCLUDED)}",
    "vulgos": f"{_TOKEN} OR lower(e) IN {_lower_list(NAMES_EXCLUDED)}",
}


def _raw_entities(s, d) -> DataFrame:
    k = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("k"))
    return k.select(F.col("k").alias("seq"), *[F.array(F.expr(_word_sql(c)), F.expr(_word_sql(c).replace("k %", "(k + 1) %"))).alias(c) for c, _, _ in CATEGORIES])


for _c, _, _ in CATEGORIES:

    def _filter(s, d, c=_c):
        return _raw_entities(s, d).select("seq", F.array_join(ent.filtered(c, F.col(c)), "|").alias("kept"))

    _both = " UNION ALL ".join(f"SELECT k AS seq, {i} AS i, {_word_sql(_c).replace('k %', f'(k + {i}) %')} AS e FROM (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders)" for i in (0, 1))
    query(f"filter_{_c}", f"SELECT seq, coalesce(string_agg(e, '|' ORDER BY i) FILTER (WHERE NOT ({_DROPS[_c]})), '') AS kept FROM ({_both}) GROUP BY seq")(_filter)

_ALL_RAW = " UNION ALL ".join(
    f"SELECT k AS seq, CASE WHEN {_DROPS[c]} THEN 1 ELSE 0 END AS gone FROM (SELECT k, {_word_sql(c).replace('k %', f'(k + {i}) %')} AS e FROM (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders))"
    for c, _, _ in CATEGORIES for i in (0, 1)
)


@query("filter_removed_count", f"SELECT seq, sum(gone) AS removed FROM ({_ALL_RAW}) GROUP BY seq")
def _(s, d):
    return ent.filter_entities(_raw_entities(s, d), "removed").select("seq", F.col("removed").cast("long").alias("removed"))


@query("gazetteer_source", f"WITH {_NARR_CHAIN}, {o.gazetteer()} SELECT seq, category, entity FROM gaz")
def _(s, d):
    return ent.gazetteer_hits(detected(s, d), terms(s), "stage1_text").select("seq", "category", "entity")


@query("stored_source", f"WITH {o.stored()} SELECT n.seq, coalesce(max(entity) FILTER (WHERE category = 'nomes'), '') AS nomes, coalesce(max(entity) FILTER (WHERE category = 'vulgos'), '') AS vulgos FROM ({nv.NARRATIVES}) n LEFT JOIN men USING (seq) GROUP BY n.seq")
def _(s, d):
    got = ent.source_stored(narr(s, d).select("seq"), nv.mentions(s, d))
    return got.select("seq", F.array_join("nomes", "|").alias("nomes"), F.array_join("vulgos", "|").alias("vulgos"))


@query("anti_echo", f"WITH {o.stored()} SELECT n.seq, count(entity) FILTER (WHERE contains({o.norm('n.text')}, {o.norm('entity')})) AS present FROM ({nv.NARRATIVES}) n LEFT JOIN (SELECT seq + 1 AS seq, entity FROM men UNION ALL SELECT seq, entity FROM men) m ON m.seq = n.seq GROUP BY n.seq")
def _(s, d):
    m = nv.mentions(s, d)
    shifted = m.withColumn("seq", F.col("seq") + 1).withColumn("idx", F.col("idx") + 10)
    got = ent.only_present(ent.source_stored(narr(s, d).select("seq", "text"), m.unionByName(shifted)), "text")
    return got.select("seq", (F.size("nomes") + F.size("vulgos")).cast("long").alias("present"))


@query("union_sources", f"WITH {_NARR_CHAIN}, {o.gazetteer()}, {o.stored()} SELECT seq, count(DISTINCT {o.norm('entity')}) FILTER (WHERE category = 'nomes') AS nomes, count(DISTINCT {o.norm('entity')}) FILTER (WHERE category = 'locais') AS locais, count(DISTINCT {o.norm('entity')}) FILTER (WHERE category = 'vulgos') AS vulgos FROM s1 LEFT JOIN (SELECT seq, category, entity FROM gaz UNION ALL SELECT seq, category, entity FROM men) USING (seq) GROUP BY seq")
def _(s, d):
    got = outputs(s, d).where("config = 'union'")
    return got.select("seq", *[F.size(c).cast("long").alias(c) for c in ("nomes", "locais", "vulgos")])


@query("chained_sources", f"WITH {_NARR_CHAIN}, {o.gazetteer()}, {o.stored()} SELECT seq, count(DISTINCT {o.norm('entity')}) FILTER (WHERE category = 'nomes') AS nomes, count(DISTINCT {o.norm('entity')}) FILTER (WHERE category = 'vulgos') AS vulgos FROM s1 LEFT JOIN (SELECT seq, category, entity FROM gaz UNION ALL SELECT men.seq, category, entity FROM men JOIN s1 b ON b.seq = men.seq AND contains({o.norm('b.t')}, {o.norm('entity')})) USING (seq) GROUP BY seq")
def _(s, d):
    got = job.chained(gaz(s), mem(s, d))(detected(s, d))
    return got.select("seq", *[F.size(c).cast("long").alias(c) for c in ("nomes", "vulgos")])


@query("chained_order", f"WITH {_NARR_CHAIN}, {o.gazetteer()}, {o.stored()} SELECT seq, count(DISTINCT {o.norm('entity')}) FILTER (WHERE category = 'nomes') AS nomes FROM s1 LEFT JOIN (SELECT seq, category, entity FROM gaz UNION ALL SELECT men.seq, category, entity FROM men JOIN s1 b ON b.seq = men.seq AND contains({o.norm('b.t')}, {o.norm('entity')})) USING (seq) GROUP BY seq")
def _(s, d):
    got = job.chained(mem(s, d), gaz(s))(detected(s, d))
    return got.select("seq", F.size("nomes").cast("long").alias("nomes"))


@query("label_map", "SELECT seq, CASE k WHEN 0 THEN 'nomes' WHEN 1 THEN 'locais' WHEN 2 THEN 'estabelecimentos' WHEN 3 THEN 'nomes' END AS category FROM (SELECT CAST(o_orderkey AS BIGINT) AS seq, CAST(o_orderkey % 5 AS INT) AS k FROM orders) WHERE k < 4")
def _(s, d):
    raw = F.expr("CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'B-PER' WHEN 1 THEN 'gpe' WHEN 2 THEN 'I-ORG' WHEN 3 THEN 'Pessoa' ELSE 'MISC' END")
    return ent.map_labels(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("seq"), raw.alias("raw_label")))


def _fake_model():
    import re

    name = re.compile(r"compareceu (\w+ \w+)")
    return lambda texts: [{"nomes": name.findall(t)} for t in texts]


@query("model_source", f"WITH {_NARR_CHAIN} SELECT seq, coalesce(nullif(regexp_extract(t, 'compareceu (\\w+ \\w+)', 1), ''), '') AS nomes FROM s1")
def _(s, d):
    return ent.source_model(detected(s, d), _fake_model).select("seq", F.array_join("nomes", "|").alias("nomes"))


# Redaction and the record pipeline

_GAZ_PLUS = f"{_NARR_CHAIN}, {o.gazetteer()}"
_RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY seq, category ORDER BY pos) AS num FROM gaz)"


@query("entity_numbering", f"WITH {_GAZ_PLUS}, {_RANKED} SELECT seq, category, entity, num FROM r")
def _(s, d):
    found = gaz(s)(detected(s, d))

    def listed(i: int, c: str, p: str):
        return F.transform(rd.numbered(F.col("stage1_text"), F.col(c), i, p, True), lambda x: F.struct(F.lit(c).alias("category"), x["entity"].alias("entity"), (x["number"] + 1).alias("num")))

    lists = [listed(i, c, p) for i, (c, p, _) in enumerate(CATEGORIES)]
    return found.select("seq", F.explode(F.concat(*lists)).alias("x")).select("seq", "x.category", "x.entity", F.col("x.num").cast("long").alias("num"))


def _replace_sql(number: bool) -> str:
    name = {c: p for c, p, _ in CATEGORIES}
    ph = "'[' || CASE category " + " ".join(f"WHEN '{c}' THEN '{p}'" for c, p in name.items()) + " END || " + ("'_' || num || ']'" if number else "']'")
    return (
        f"WITH RECURSIVE {_GAZ_PLUS}, {_RANKED}, o AS (SELECT seq, entity, {ph} AS ph, row_number() OVER (PARTITION BY seq ORDER BY length(entity) DESC, category, num) AS k FROM r), "
        "z(seq, k, t) AS (SELECT seq, 0::BIGINT, t FROM s1 UNION ALL SELECT z.seq, o.k, replace(z.t, o.entity, o.ph) FROM z JOIN o ON o.seq = z.seq AND o.k = z.k + 1) "
        "SELECT seq, arg_max(t, k) AS redacted, max(k) AS replaced FROM z GROUP BY seq"
    )


for _name, _number in (("redact_numbered", True), ("redact_plain", False)):

    def _redact(s, d, number=_number):
        done = rd.redact(gaz(s)(detected(s, d)), "stage1_text", "redacted", "replaced", number)
        return done.select("seq", "redacted", F.col("replaced").cast("long").alias("replaced"))

    query(_name, _replace_sql(_number))(_redact)


@query("anonymize_records")
def _(s, d):
    """The whole record pipeline with the union of both sources."""
    out = job.anonymize(narr(s, d).select("seq", "text"), job.PRESETS["union"](a=gaz(s), b=mem(s, d)))
    return out.select("seq", "redacted", "status", F.size("nomes").alias("nomes"), F.size("locais").alias("locais"))


_SHRUNK = "CASE WHEN seq % 7 = 0 THEN substr(t, 1, 10) WHEN seq % 7 = 1 THEN replace(t, '[DATA]', '') ELSE t END"


@query("validate_status", f"WITH {_NARR_CHAIN} SELECT seq, CASE WHEN {o.placeholder_count(_SHRUNK)} < {o.placeholder_count('t')} OR (length(t) > 50 AND length({_SHRUNK}) < 0.3 * length(t)) THEN 'fallback_estagio1' ELSE 'ok' END AS status FROM s1")
def _(s, d):
    both = detected(s, d).select("seq", F.col("stage1_text").alias("t")).withColumn("after", F.expr(_SHRUNK))
    return both.select("seq", F.when(job.valid(F.col("t"), F.col("after")), "ok").otherwise("fallback_estagio1").alias("status"))


def _run_rows(s, d) -> DataFrame:
    rows = s.read.parquet(f"{d}/orders.parquet").selectExpr(
        "CAST(o_orderkey AS BIGINT) AS seq", "concat('run', CAST(o_orderkey % 3 AS STRING)) AS config",
        "CASE WHEN o_orderkey % 11 = 0 THEN 'fallback_estagio1' WHEN o_orderkey % 13 = 0 THEN 'vazio' ELSE 'ok' END AS status",
        "CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 1000 END AS latency_s",
        "CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 100 AS INT) END AS prompt_tokens", "CAST(o_orderkey % 50 AS INT) AS completion_tokens",
    )
    return rows


_RUNS = (
    "runs AS (SELECT CAST(o_orderkey AS BIGINT) AS seq, 'run' || CAST(o_orderkey % 3 AS VARCHAR) AS config, "
    "CASE WHEN o_orderkey % 11 = 0 THEN 'fallback_estagio1' WHEN o_orderkey % 13 = 0 THEN 'vazio' ELSE 'ok' END AS status, "
    "CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 1000 END AS latency_s, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 100 END AS prompt_tokens, "
    "o_orderkey % 50 AS completion_tokens FROM orders)"
)


@query("status_counts", f"WITH {_RUNS} SELECT config, status, count(*) AS n FROM runs GROUP BY ALL")
def _(s, d):
    return job.status_counts(_run_rows(s, d))


@query("latency_tokens", f"WITH {_RUNS} SELECT config, count(*) AS n, round(avg(coalesce(latency_s, 0)), 6) AS mean_latency, round(avg(coalesce(prompt_tokens, 0)), 6) AS mean_prompt, round(avg(completion_tokens), 6) AS mean_completion FROM runs GROUP BY config")
def _(s, d):
    return rounded(job.mean_costs(_run_rows(s, d)))


@query("resume_pending", "SELECT CAST(o_orderkey AS BIGINT) AS seq FROM orders WHERE o_orderstatus <> 'F'")
def _(s, d):
    orders = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("seq"), "o_orderstatus")
    return job.pending(orders.select("seq"), orders.where("o_orderstatus = 'F'"))


@query("sample_first_n", "SELECT CAST(o_orderkey AS BIGINT) AS seq, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 500")
def _(s, d):
    return io.first_records(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("seq"), "o_orderstatus"), 500)


@query("output_round_trip", f"WITH {_PROBE_CHAIN}, {_CAPS} SELECT CAST(seq AS VARCHAR) AS seq, label, count(*) AS spans FROM caps GROUP BY ALL")
def _(s, d):
    """Captures to JSON and back."""
    out = job.finish(ent.source_none(io.stage(dt.stage1(nv.probes(s, d)))))
    back = io.from_rows(io.to_rows(out))
    return back.select("seq", F.explode("captures").alias("label", "x")).select("seq", "label", F.size("x").cast("long").alias("spans"))


# Gold, matching, scores

_GOLD = o.gold()


@query("gold_long", f"WITH {_GOLD} SELECT CAST(seq AS VARCHAR) AS seq, tipo, orig, norm FROM gold")
def _(s, d):
    return sc.gold_long(sc.gold_arrays(narr(s, d)))


@query("gold_profile", f"WITH {_GOLD} SELECT tipo, count(*) AS n FROM gold GROUP BY tipo")
def _(s, d):
    return sc.gold_profile(sc.gold_arrays(narr(s, d)))


_OUT = o.outputs()
_FATES = f"{_OUT}, {o.fates()}"
_STATS = f"{_OUT}, {o.stats()}"
_SUMM = f"{_STATS}, {o.BY_TYPE}, {o.SUMMARY}"


@query("institutional_reclass", f"WITH {_GOLD} SELECT CAST(seq AS VARCHAR) AS seq, orig FROM gold WHERE tipo = 'institucional'")
def _(s, d):
    return sc.gold_long(sc.gold_arrays(narr(s, d))).where("tipo = 'institucional'").select("seq", "orig")


@query("institutional_removed", f"WITH {_FATES} SELECT config, count(*) AS total, count(*) FILTER (WHERE any_hit) AS removed FROM fate WHERE tipo = 'institucional' GROUP BY config")
def _(s, d):
    return sc.institutional_removed(pairs(s, d))


@query("match_tp_leak", f"WITH {_FATES} SELECT config, CAST(seq AS VARCHAR) AS seq, tipo, norm, tp, NOT tp AND NOT any_hit AS leak FROM fate WHERE tipo <> 'institucional'")
def _(s, d):
    return sc.match_table(pairs(s, d))


@query("false_positives", f"WITH {_FATES} SELECT config, CAST(seq AS VARCHAR) AS seq, tipo, norm FROM over")
def _(s, d):
    return sc.false_positives(pairs(s, d))


@query("record_stats", f"WITH {_STATS} SELECT config, CAST(seq AS VARCHAR) AS seq, tipo, tp, fn, fp, leak, gold FROM stats")
def _(s, d):
    return stats(s, d)


@query("scores_by_type", f"WITH {_STATS}, {o.BY_TYPE} SELECT config, tipo, tp, fn, fp, leak, gold, round(recall, 6) AS recall, round(prec, 6) AS precision, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy, round(safety_recall, 6) AS safety_recall FROM byt")
def _(s, d):
    return rounded(sc.scores_by_type(sums(s, d)))


@query("scores_rollup", f"WITH {_STATS} SELECT config, tipo, sum(tp) AS tp, sum(fn) AS fn, sum(fp) AS fp, sum(leak) AS leak, sum(gold) AS gold FROM stats GROUP BY ROLLUP (config, tipo) HAVING config IS NOT NULL")
def _(s, d):
    return sc.totals_rollup(stats(s, d))


@query("scores_summary", f"WITH {_SUMM} SELECT config, round(micro_recall, 6) AS micro_recall, round(micro_precision, 6) AS micro_precision, round(micro_f1, 6) AS micro_f1, round(macro_f1, 6) AS macro_f1, round(macro_safety, 6) AS macro_safety FROM summ")
def _(s, d):
    return rounded(sc.summary(sums(s, d)).select("config", "micro_recall", "micro_precision", "micro_f1", "macro_f1", "macro_safety"))


@query("error_table", f"WITH {_STATS} SELECT config, tipo, fn AS fn_total, leak AS leaked, fn - leak AS removed_otherwise FROM sums")
def _(s, d):
    return sc.error_table(sums(s, d))


@query("top_fn", f"WITH {_STATS} SELECT config, seq, n_fn FROM (SELECT config, CAST(seq AS VARCHAR) AS seq, sum(fn) AS n_fn, row_number() OVER (PARTITION BY config ORDER BY sum(fn) DESC, CAST(seq AS VARCHAR) DESC) AS r FROM stats GROUP BY config, seq HAVING sum(fn) > 0) WHERE r <= 30")
def _(s, d):
    return sc.top_misses(stats(s, d))


def _costs(out: DataFrame) -> DataFrame:
    rows = out.select("config", F.length("stage1_text").alias("prompt_tokens"), F.size("nomes").alias("completion_tokens"), (F.col("seq") % 10 / 1000).alias("latency_s"))
    return job.mean_costs(rows).drop("mean_prompt")


@query("comparison_table", f"WITH {_SUMM}, ent AS (SELECT config, s1.seq, CASE config WHEN 'regex_only' THEN 0 ELSE (SELECT count(DISTINCT {o.norm('entity')}) FROM (SELECT seq, category, entity, 'gazetteer' AS src FROM gaz UNION ALL SELECT seq, category, entity, 'union' FROM men) x WHERE x.seq = s1.seq AND x.category = 'nomes' AND (src = 'gazetteer' OR configs.config = 'union')) END AS names FROM s1, configs), c AS (SELECT config, count(*) AS n, round(avg(seq % 10 / 1000), 6) AS mean_latency, round(avg(names), 6) AS mean_completion FROM ent GROUP BY config) SELECT config, n, round(micro_recall, 6) AS micro_recall, round(micro_precision, 6) AS micro_precision, round(micro_f1, 6) AS micro_f1, round(macro_f1, 6) AS macro_f1, round(macro_safety, 6) AS macro_safety, round(recall_nome, 6) AS recall_nome, round(recall_local, 6) AS recall_local, round(recall_documento, 6) AS recall_documento, mean_latency, mean_completion FROM summ JOIN c USING (config)")
def _(s, d):
    found = io.stage(records(s, d))
    return rounded(sc.comparison(sums(s, d, found), _costs(outputs(s, d, found))))


# Bootstrap

_BOOT = f"{_STATS}, {o.replicates(REPLICATES)}"


def _metrics(s, d) -> DataFrame:
    return bs.replicate_metrics(bs.replicate_sums(stats(s, d), REPLICATES))


@query("bootstrap_sums", f"WITH {_BOOT} SELECT config, b, tipo, tp, fn, fp, leak, gold FROM rsums")
def _(s, d):
    return bs.replicate_sums(stats(s, d), REPLICATES)


@query("bootstrap_replicates", f"WITH {_BOOT} SELECT config, b, round(safety, 6) AS safety, round(micro_f1, 6) AS micro_f1 FROM metrics")
def _(s, d):
    return rounded(_metrics(s, d))


@query("bootstrap_ci", f"WITH {_BOOT} SELECT config, " + ", ".join(f"round(quantile_cont({c}, {p}), 6) AS {c}_{n}" for c in ("safety", "micro_f1") for p, n in ((0.025, "low"), (0.975, "high"))) + " FROM metrics GROUP BY config")
def _(s, d):
    return rounded(bs.intervals(_metrics(s, d)))


_ORD = "list_position(" + str(CONFIGS) + ", {x}.config)"


@query("bootstrap_paired", f"WITH {_BOOT}, dd AS (SELECT a.config AS config_a, b.config AS config_b, unnest(['safety', 'micro_f1']) AS metric, unnest([a.safety - b.safety, a.micro_f1 - b.micro_f1]) AS d FROM metrics a JOIN metrics b ON a.b = b.b AND {_ORD.format(x='a')} < {_ORD.format(x='b')}) SELECT config_a, config_b, metric, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high, quantile_cont(d, 0.025) <= 0 AND quantile_cont(d, 0.975) >= 0 AS has_zero FROM dd GROUP BY ALL")
def _(s, d):
    return rounded(bs.paired(_metrics(s, d), CONFIGS))


@query("run_variance", f"WITH {_RUNS} SELECT config, round(avg(latency_s), 6) AS mean, round(coalesce(stddev_samp(latency_s), 0), 6) AS spread FROM runs GROUP BY config")
def _(s, d):
    return rounded(bs.run_spread(_run_rows(s, d), "latency_s"))


# Utility, reconciliation, replay


def _kept(out: DataFrame) -> DataFrame:
    return ut.retention(out.withColumn("redacted", rd.redacted(F.col("stage1_text"), {c: F.col(c) for c in ent.CATS})["text"]))


def _kept_sql() -> str:
    kept = "least(1.0, length(regexp_replace(t, '\\[[A-Z_]+\\d*\\]', '', 'g')) / length(text))"
    return f"SELECT 'regex_only' AS config, round(avg({kept}), 6) AS retention, round(avg(1 - {kept}), 6) AS replaced_share FROM s1 WHERE length(text) > 0"


@query("retention", f"WITH {_NARR_CHAIN} {_kept_sql()}")
def _(s, d):
    return rounded(ut.retention(detected(s, d).select(F.lit("regex_only").alias("config"), "text", F.col("stage1_text").alias("redacted"))))


@query("utility_table")
def _(s, d):
    found = io.stage(records(s, d))
    return rounded(ut.utility_table(sums(s, d, found), _kept(outputs(s, d, found))))


@query("over_removal", f"WITH {_STATS} SELECT config, round(CASE WHEN sum(tp + fp) > 0 THEN sum(fp) / sum(tp + fp) ELSE 0 END, 6) AS over_removal FROM sums GROUP BY config")
def _(s, d):
    t = sums(s, d).groupBy("config").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    return rounded(t.select("config", sc.ratio(F.col("fp"), F.col("tp") + F.col("fp")).alias("over_removal")))


@query("reconcile_points", f"WITH {_SUMM} SELECT config, round(macro_safety, 6) AS value, CASE config WHEN 'regex_only' THEN round(macro_safety, 6) WHEN 'gazetteer' THEN round(macro_safety + 0.001, 6) END AS frozen, CASE WHEN config = 'regex_only' THEN 'ok' ELSE 'diverges' END AS state FROM summ")
def _(s, d):
    points = sc.summary(sums(s, d)).select("config", "macro_safety")
    frozen = points.where("config <> 'union'").select("config", (F.col("macro_safety") + F.when(F.col("config") == "gazetteer", 0.001).otherwise(0.0)).alias("macro_safety"))
    return rounded(ut.reconcile_points(points, frozen, "macro_safety"))


@query("reconcile_counts", "SELECT * FROM (VALUES ('regex_only', 'ok', 0::BIGINT), ('gazetteer', 'diverges', 1::BIGINT), ('union', 'no file', 8::BIGINT)) AS t(config, state, differing)")
def _(s, d):
    t = sums(s, d)
    wrong = F.when((F.col("config") == "gazetteer") & (F.col("tipo") == "nome"), F.col("tp") + 1).otherwise(F.col("tp"))
    return ut.reconcile_counts(t, t.where("config <> 'union'").withColumn("tp", wrong))


@query("tradeoff_table")
def _(s, d):
    found = io.stage(records(s, d))
    rows = io.stage(stats(s, d, found))
    return rounded(ut.tradeoff(ut.utility_table(sc.totals(rows), _kept(outputs(s, d, found))), bs.intervals(bs.replicate_metrics(bs.replicate_sums(rows, REPLICATES))), CONFIGS))


def _replayed(s, d) -> tuple[DataFrame, DataFrame]:
    """Stats of the detectors alone, without and with the plate detector's captures."""
    one = ent.source_none(detected(s, d)).withColumn("config", F.lit("regex_only"))
    old = one.withColumn("captures", F.map_filter("captures", lambda k, _: k != "PLACA"))
    gold = sc.gold_arrays(narr(s, d))
    return sc.record_stats(sc.matched(old, gold)), sc.record_stats(sc.matched(one, gold))


@query("replay_changed_types", f"WITH {_STATS} SELECT config, tipo, gold AS leak_before, leak AS leak_after, gold AS fn_before, fn AS fn_after FROM sums WHERE config = 'regex_only' AND tipo = 'placa' AND gold > 0")
def _(s, d):
    return ut.replay_changes(*_replayed(s, d))


@query("replay_before_after")
def _(s, d):
    return rounded(ut.replay_table(*_replayed(s, d)))


_PLATE = tuple(x for x in dt.DETECTORS if x.label == "PLACA")
_LABELLED = "SELECT seq, label, string_agg(span, '|' ORDER BY code, i) AS spans FROM caps GROUP BY seq, label"


@query("replay_override", f"WITH {_NARR_CHAIN}, {_CAPS} {_LABELLED}")
def _(s, d):
    """Outputs stored before the plate detector existed, replayed with it: the captures of a run of all detectors."""
    old = tuple(x for x in dt.DETECTORS if x not in _PLATE)
    stored = io.stage(dt.stage1(narr(s, d).select("seq", "text"), detectors=old))
    found = ut.replayed(stored, old, dt.DETECTORS).select("seq", F.explode("captures").alias("label", "found"))
    return found.select("seq", "label", F.array_join("found", "|").alias("spans"))


# Records that are blank, repeated, or written more than once

_BLANKED = "CASE seq % 9 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE text END"


@query("anonymize_light", f"WITH {o.chain(f'SELECT seq, text FROM ({nv.NARRATIVES}) WHERE seq % 9 > 1')} SELECT n.seq, coalesce(t, '') AS redacted, CASE WHEN n.seq % 9 > 1 THEN 'ok' ELSE 'vazio' END AS status, 0::INTEGER AS tokens FROM ({nv.NARRATIVES}) n LEFT JOIN s1 ON s1.seq = n.seq")
def _(s, d):
    """The record pipeline's detectors-only preset; some records are blank or null."""
    some = narr(s, d).select("seq", F.expr(_BLANKED).alias("text"))
    out = job.anonymize(some, job.PRESETS["light"]())
    return out.select("seq", "redacted", "status", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"))


@query("gold_latest", f"WITH {_GOLD} SELECT CAST(seq AS VARCHAR) AS seq, tipo, orig, norm FROM gold")
def _(s, d):
    """Records annotated twice: only the newer annotation counts."""
    new = narr(s, d).withColumn("version", F.lit(2))
    old = new.withColumns({"nomes": F.lit("Outra Pessoa"), "version": F.lit(1)})
    return sc.gold_long(sc.gold_arrays(old.unionByName(new), version="version"))


@query("log_rerun", f"WITH {_RUNS} SELECT CAST(seq AS VARCHAR) AS seq, status, CAST(CASE WHEN seq % 2 = 0 THEN 'even' ELSE 'odd' END AS VARCHAR) AS batch FROM runs")
def _(s, d):
    """A progress log of two batches, the first of which is run again."""
    rows = _run_rows(s, d).select(
        F.col("seq").cast("string").alias("seq"), F.lit("x").alias("text"), F.lit("x").alias("redacted"), F.create_map().cast(io.CAPTURES).alias("captures"),
        *[ent.no_entities().alias(c) for c in ent.CATS], "status", (F.col("seq") % 2 == 0).alias("even"),
    )
    path = io.shared_folder(s)
    for batch in ("even", "odd", "even"):
        io.write_log(rows.where(F.col("even") == (batch == "even")).drop("even"), path, batch)
    return io.read_log(s, path).select("seq", "status", "batch")


@query("table_rerun", f"WITH {_RUNS} SELECT config, status, count(*) AS n FROM runs GROUP BY ALL")
def _(s, d):
    """A metric table whose batch is written twice."""
    path, rows = io.shared_folder(s), job.status_counts(_run_rows(s, d))
    for _ in range(2):
        io.write_table(rows, path, "first")
    return s.read.parquet(path).select("config", "status", "n")


@query("frozen_tables", f"WITH {_STATS} SELECT config, tipo, CAST(tp AS BIGINT) AS tp, CASE WHEN config <> 'union' THEN CAST(fn AS BIGINT) END AS fn, CASE WHEN config <> 'regex_only' THEN CAST(fp AS BIGINT) END AS fp FROM sums")
def _(s, d):
    """Tables by type as text files, one for each configuration, whose headers differ in order and columns."""
    t, path = io.stage(sums(s, d)), io.shared_folder(s)
    for config, columns in {"regex_only": ["tipo", "tp", "fn"], "gazetteer": ["fp", "fn", "gold", "tp", "tipo"], "union": ["tp", "fp", "tipo"]}.items():
        io.write_csv(t.where(F.col("config") == config).select(columns), f"{path}/{config}_por_tipo.csv")
    return io.read_frozen(s, f"{path}/*_por_tipo.csv", "tipo string, tp long, fn long, fp long")
