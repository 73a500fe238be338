"""Oracle SQL, put together from the same patterns and lists as the DataFrame form, but by another route.

Predictions and gold are exploded and joined where the DataFrame form compares arrays inside a record; the other
engine's regular expressions are ASCII for ``\\b`` and ``\\w``, which the derived narratives respect.
"""

from __future__ import annotations

from veilspark.functions import detectors as dt
from veilspark.functions.lexicons import CATEGORIES, COUNTED, INSTITUTIONAL, LABEL_TYPES, TYPES
from veilspark.operators.bootstrap import SEED, poisson_steps
from veilspark.sources.narratives import MENTIONS, NARRATIVES, PROBES, gazetteer_terms


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def pattern(d: dt.Detector) -> str:
    return q(("(?i)" if d.ignore_case else "") + d.pattern)


def chain(source: str, skip: tuple[str, ...] = ()) -> str:
    """CTEs n (seq, text) to s1 (seq, text, t, c_<code>...): the whole detector chain over ``source``."""
    parts, last = [f"n AS ({source})", "t0 AS (SELECT seq, text, CASE WHEN trim(coalesce(text, '')) = '' THEN '' ELSE text END AS t FROM n)"], "t0"

    def step(name: str, sql: str) -> None:
        nonlocal last
        parts.append(f"{name} AS MATERIALIZED (SELECT {sql} FROM {last})")
        last = name

    for d in dt.DETECTORS[:27]:
        if d.code in skip:
            step(f"t_{d.code}", f"*, []::VARCHAR[] AS c_{d.code}")
        else:
            step(f"t_{d.code}", f"* REPLACE (regexp_replace(t, {pattern(d)}, '[{d.label}]', 'g') AS t), regexp_extract_all(t, {pattern(d)}, 0) AS c_{d.code}")
    law, art = q("(?i)" + dt.law_pattern()), q("(?i)" + dt.article_pattern())
    step("t_law", f"* REPLACE (regexp_replace(t, {law}, '{dt.LAW_MARK}', 'g') AS t), regexp_extract_all(t, {law}, 0) AS laws")
    step("t_art", f"* REPLACE (regexp_replace(t, {art}, '{dt.ARTICLE_MARK}', 'g') AS t), regexp_extract_all(t, {art}, 0) AS arts")
    for d in dt.SWEEPS:
        step(f"t_{d.code}", f"* REPLACE (regexp_replace(t, {pattern(d)}, '[{d.label}]', 'g') AS t), regexp_extract_all(t, {pattern(d)}, 0) AS c_{d.code}")
    for mark, cited in ((dt.ARTICLE_MARK, "arts"), (dt.LAW_MARK, "laws")):
        step(f"t_r_{cited}", f"* REPLACE (array_to_string(list_transform(string_split(t, '{mark}'), lambda p, i: p || coalesce({cited}[i], '')), '') AS t)")
    t = "t"
    for label in dt.COLLAPSED:
        t = f"regexp_replace({t}, '(\\[{label}\\])(\\s*\\[{label}\\])+', '[{label}]', 'g')"
    step("s1", f"* REPLACE (regexp_replace({t}, '  +', ' ', 'g') AS t)")
    return ", ".join(parts)


def norm(x: str) -> str:
    return f"regexp_replace(strip_accents(lower(trim({x}))), '[^a-zA-Z0-9_]', '', 'g')"


def label_order() -> str:
    return "CASE label " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(dt.detector_labels())) + " END"


def captured() -> str:
    """CTE caps (seq, code, i, label, span) over s1."""
    rows = [
        f"SELECT seq, '{d.code}' AS code, generate_subscripts(c_{d.code}, 1) AS i, '{d.label}' AS label, unnest(c_{d.code}) AS span FROM s1 WHERE len(c_{d.code}) > 0"
        for d in dt.DETECTORS
    ]
    return "caps AS (" + " UNION ALL ".join(rows) + ")"


def gazetteer(source: str = "s1", text: str = "t", name: str = "gaz") -> str:
    """CTE (seq, category, pos, entity): every dictionary term that stands in the text as whole words."""
    terms = ", ".join(f"('{c}', {q(t)})" for c, t in gazetteer_terms())
    padded = f"' ' || lower(regexp_replace({text}, '[^0-9A-Za-zÀ-ÿ]', ' ', 'g')) || ' '"
    return (
        f"{name} AS (SELECT seq, category, place AS pos, substr({text}, CAST(place AS BIGINT), length(term)) AS entity FROM ("
        f"SELECT s.*, category, term, instr({padded}, ' ' || lower(term) || ' ') AS place FROM {source} s, (VALUES {terms}) AS g(category, term)) WHERE place > 0)"
    )


def stored(name: str = "men") -> str:
    return (
        f"{name} AS (SELECT seq, 'nomes' AS category, 0 AS pos, nome AS entity FROM ({MENTIONS}) WHERE nome IS NOT NULL "
        f"UNION ALL SELECT seq, 'vulgos', 1, vulgo FROM ({MENTIONS}) WHERE vulgo IS NOT NULL)"
    )


def _typed(label: str) -> str:
    return "CASE " + label + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABEL_TYPES.items()) + " END"


def _cat_type(c: str) -> str:
    return "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, _, t in CATEGORIES) + " END"


def gold() -> str:
    """CTE gold (seq, tipo, i, orig, norm)."""
    rows = []
    for i, (tipo, _, column) in enumerate(TYPES):
        kind = f"CASE WHEN regexp_matches(orig, {q('(?i)' + INSTITUTIONAL)}) THEN 'institucional' ELSE 'documento' END" if tipo == "documento" else f"'{tipo}'"
        rows.append(f"SELECT seq, {kind} AS tipo, {i} * 100 + i AS i, orig, {norm('orig')} AS norm FROM (SELECT seq, generate_subscripts(string_split({column}, ';'), 1) AS i, trim(unnest(string_split({column}, ';'))) AS orig FROM ({NARRATIVES}) WHERE {column} IS NOT NULL)")
    return "gold AS (SELECT * FROM (" + " UNION ALL ".join(rows) + ") WHERE norm <> '')"


def outputs(skip: tuple[str, ...] = ()) -> str:
    """CTEs up to preds (config, seq, tipo, norm) for the three configurations scored, and configs (config)."""
    return ", ".join([
        chain(f"SELECT seq, text FROM ({NARRATIVES})", skip), captured(), gazetteer(), stored(),
        "configs AS (SELECT unnest(['regex_only', 'gazetteer', 'union']) AS config)",
        f"preds AS MATERIALIZED (SELECT config, seq, {_typed('label')} AS tipo, {norm('span')} AS norm FROM caps, configs "
        f"UNION ALL SELECT config, seq, {_cat_type('category')}, {norm('entity')} FROM gaz, configs WHERE config <> 'regex_only' "
        f"UNION ALL SELECT 'union', seq, {_cat_type('category')}, {norm('entity')} FROM men)",
    ])


def _match(a: str, b: str) -> str:
    return f"({a} = {b} OR (length({a}) >= 4 AND length({b}) >= 4 AND (contains({a}, {b}) OR contains({b}, {a}))))"


def fates() -> str:
    """CTEs gold, g (numbered gold of each config), fate (config, seq, tipo, norm, tp, any_hit) and over (false positives)."""
    return ", ".join([
        gold(), "g AS (SELECT config, gold.*, row_number() OVER () AS id FROM gold, configs)",
        f"hits AS (SELECT g.id, bool_or(p.tipo = g.tipo) AS own FROM g JOIN preds p ON p.config = g.config AND p.seq = g.seq AND p.norm <> '' AND {_match('g.norm', 'p.norm')} GROUP BY g.id)",
        "fate AS MATERIALIZED (SELECT g.config, g.seq, g.tipo, g.norm, coalesce(own, false) AS tp, hits.id IS NOT NULL AS any_hit FROM g LEFT JOIN hits ON g.id = hits.id)",
        f"over AS MATERIALIZED (SELECT DISTINCT p.config, p.seq, p.tipo, p.norm FROM preds p WHERE p.tipo IS NOT NULL AND p.norm <> '' AND NOT EXISTS (SELECT 1 FROM gold WHERE gold.seq = p.seq AND gold.tipo = p.tipo AND {_match('gold.norm', 'p.norm')}))",
    ])


def stats() -> str:
    """CTEs up to stats (config, seq, tipo, tp, fn, fp, leak, gold), zeros included."""
    types = ", ".join(f"'{t}'" for t, _, _ in TYPES)
    return ", ".join([
        fates(), f"types AS (SELECT unnest([{types}]) AS tipo)",
        "f AS (SELECT config, seq, tipo, count(*) FILTER (WHERE tp) AS tp, count(*) FILTER (WHERE NOT tp) AS fn, count(*) FILTER (WHERE NOT tp AND NOT any_hit) AS leak, count(*) AS gold FROM fate GROUP BY ALL)",
        "o AS (SELECT config, seq, tipo, count(*) AS fp FROM over GROUP BY ALL)",
        "stats AS MATERIALIZED (SELECT c.config, n.seq, t.tipo, coalesce(f.tp, 0) AS tp, coalesce(f.fn, 0) AS fn, coalesce(o.fp, 0) AS fp, coalesce(f.leak, 0) AS leak, coalesce(f.gold, 0) AS gold "
        "FROM configs c, n, types t LEFT JOIN f ON f.config = c.config AND f.seq = n.seq AND f.tipo = t.tipo LEFT JOIN o ON o.config = c.config AND o.seq = n.seq AND o.tipo = t.tipo)",
        "sums AS MATERIALIZED (SELECT config, tipo, sum(tp) AS tp, sum(fn) AS fn, sum(fp) AS fp, sum(leak) AS leak, sum(gold) AS gold FROM stats GROUP BY ALL)",
    ])


RATES = (
    "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS prec"
)
F1 = "CASE WHEN recall + prec > 0 THEN 2 * recall * prec / (recall + prec) ELSE 0 END"
SAFE = "CASE WHEN gold > 0 THEN 1 - leak / gold ELSE 0 END"
BY_TYPE = f"byt AS (SELECT *, {F1} AS f1, CASE WHEN tp + fn + fp > 0 THEN tp / (tp + fn + fp) ELSE 0 END AS accuracy, {SAFE} AS safety_recall FROM (SELECT *, {RATES} FROM sums))"
SUMMARY = (
    f"summ AS (SELECT config, macro_f1, macro_safety, recall_nome, recall_local, recall_documento, tp, fp, fn, leak, recall AS micro_recall, prec AS micro_precision, {F1} AS micro_f1 FROM "
    f"(SELECT *, {RATES} FROM (SELECT config, avg(f1) AS macro_f1, avg(safety_recall) AS macro_safety, sum(tp) AS tp, sum(fn) AS fn, sum(fp) AS fp, sum(leak) AS leak, "
    + ", ".join(f"max(recall) FILTER (WHERE tipo = '{t}') AS recall_{t}" for t in ("nome", "local", "documento")) + " FROM byt GROUP BY config)))"
)


def replicates(n: int) -> str:
    """CTEs rsums and metrics over stats."""
    steps = " + ".join(f"CAST(u >= {x!r} AS INT)" for x in poisson_steps())
    u = f"CAST(('0x' || substr(md5('{SEED}-' || CAST(seq AS VARCHAR) || '-' || CAST(b AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0"
    return (
        f"ids AS (SELECT DISTINCT seq FROM stats), w AS (SELECT seq, b, {steps} AS w FROM (SELECT seq, b, CAST({u} AS DOUBLE) AS u FROM ids, range({n}) AS r(b))), "
        "rsums AS (SELECT config, CAST(b AS INT) AS b, tipo, " + ", ".join(f"sum(w * {c}) AS {c}" for c in ("tp", "fn", "fp", "leak", "gold"))
        + " FROM (SELECT * FROM stats WHERE tp + fn + fp + leak + gold > 0) s JOIN w USING (seq) WHERE w > 0 GROUP BY ALL), "
        f"metrics AS (SELECT config, b, safety, {F1} AS micro_f1 FROM (SELECT *, {RATES} FROM (SELECT config, b, avg(1 - leak / nullif(gold, 0)) AS safety, sum(tp) AS tp, sum(fn) AS fn, sum(fp) AS fp FROM rsums GROUP BY ALL)))"
    )


def placeholder_count(x: str) -> str:
    return f"len(regexp_extract_all({x}, '\\[(?:{'|'.join(COUNTED)})\\]'))"


__all__ = ["PROBES"]
