"""Structured-identifier detectors: an ordered list of patterns, and the chain that applies them.

Each detector replaces every match by ``[LABEL]`` and records the matched strings; it sees what the earlier ones left.
The order is part of the result: the most specific forms come first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERO = r"(?:n[.ºo°]*\s*)?"
MESES = "janeiro|fevereiro|mar[çc]o|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro"


@dataclass(frozen=True)
class Detector:
    """``gate``: what a text must hold for the pattern to match at all; cheaper to test than the pattern.

    A text of ASCII letters only must besides hold one of ``words`` (in any case) or ``shapes``, unless there are none.
    """

    code: str
    label: str
    pattern: str
    ignore_case: bool = False
    gate: str = "digit"
    words: tuple[str, ...] = ()
    shapes: tuple[str, ...] = ()

    @property
    def java(self) -> str:
        """With Unicode classes, boundaries and case, as the forms were written for."""
        return ("(?iU)" if self.ignore_case else "(?U)") + self.pattern

    @property
    def plain(self) -> str:
        """The same on ASCII texts, where Unicode classes only take time."""
        return ("(?i)" if self.ignore_case else "") + self.pattern


# The published scores depend on these very forms, quirks included.
DETECTORS = (
    Detector("d01", "URL", r'https?://[^\s<>"]+|www\.[^\s<>"]+', True, "url", ("http", "www.")),
    Detector("d02", "EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", False, "at", ("@",)),
    Detector("d03", "PROCESSO", r"\b\d{7}-?\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}\b", shapes=("run",)),
    Detector("d04", "PROCESSO", rf"(?:processo(?:\s+CNJ)?|autos?|inqu[ée]rito|IP|IPL)\s*{NUMERO}:?\s*[\d][\d./-]{{4,}}", True, words=("processo", "auto", "inqu", "ip")),
    Detector("d05", "PROTOCOLO", r"protocolo\s*:?\s*(?:REQ)?[\dA-Z][\dA-Z./-]{4,}", True, "protocol", ("protocolo",)),
    Detector(
        "d06", "BO",
        rf"(?:boletim(?:\s+de\s+ocorr[êe]ncia)?|B\.?O\.?(?:\s*/?\s*PM)?|BOPM)\s*{NUMERO}:?\s*"
        r"(?:[A-Z]{2}\s?\d{4,5}(?:-\d)?(?:/\d{4})?|\d{4,})", True, words=("bo", "b.o"),
    ),
    Detector("d07", "OFICIO", rf"of[íi]cio\s*{NUMERO}:?\s*\d[\d/.]*(?:-[A-Za-z]+)?", True, words=("oficio",)),
    Detector("d08", "CODIGO", rf"\b(?:NOC|RE|RF|SAEP|RDO|COPOM|IML)\b\s*(?:-?\s*PESSOA)?\s*{NUMERO}:?\s*\d{{4,}}", True, words=("noc", "rf", "saep", "rdo", "copom", "iml", *(f"re{x}" for x in "-: \t\n\v\f\r"))),
    Detector("d09", "CPF", r"\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b", shapes=("dots",)),
    Detector("d10", "REG_PROF", r"\b(?:OAB|CRM|CREA|CRO|CRP)\s*[-/]?\s*[A-Z]{0,2}\s*n?[.ºo°]*\s*:?\s*\d{3,}", True, words=("oab", "crm", "crea", "cro", "crp")),
    Detector("d11", "IMEI", r"\bIMEI\s*:?\s*\d[\d.\s-]{10,}\d|\b\d{15}\b", True, words=("imei",), shapes=("run",)),
    Detector("d12", "CPF", r"\bCPF\s*:?\s*\d{3}[.\s]?\d{3}[.\s]?\d{3}[-.\s]?\d{2}\b|\b\d{3}\.\d{3}\.\d{3}-\d{2}\b|\b\d{11}\b", True, words=("cpf",), shapes=("dots", "run")),
    Detector("d13", "RG", rf"\bRG\s*:?\s*{NUMERO}[\d][\d.\s-]{{4,12}}[-]?[\dXx]?\b|\b\d{{1,2}}\.\d{{3}}\.\d{{3}}-[\dXx]{{1,3}}\b|\b\d{{7,8}}-[\dXx]\b", True, words=("rg",), shapes=("dots", "run")),
    Detector("d14", "CNH", r"\bCNH\s*:?\s*\d{9,11}\b", True, words=("cnh",)),
    Detector("d15", "TELEFONE", r"\+\d{1,3}\s*\d[\d\s.()-]{7,}", words=("+",)),
    Detector(
        "d16", "TELEFONE",
        r"(?:telefone|fone|cel(?:ular)?|whats(?:app)?)\s*:?\s*(?:\(?\d{2,3}\)?\s*)?(?:9\s*)?\d{4,5}[-.\s]?\d{4}", True, words=("fone", "cel", "whats"),
    ),
    Detector("d17", "TELEFONE", r"\(?\b0?[1-9][0-9]\)?\s*[-.]?\s*(?:9\s*\d{4}|\d{4,5})[-.\s]?\d{4,5}\b", shapes=("pair",)),
    Detector("d18", "DATA", rf"\b\d{{1,2}}\s+de\s+(?:{MESES})\s+de\s+\d{{4}}", True),
    Detector("d19", "DATA", r"\b\d{2}/\d{2}/\d{2,4}\b"),
    Detector("d20", "DATA", r"\b\d{2}[.-]\d{2}[.-]\d{2,4}\b"),
    Detector("d21", "VIATURA", rf"(?:viatura|VTR)\s*(?:de\s+)?(?:prefixo\s+)?{NUMERO}(?:[A-Z]{{1,5}}\s+)?[A-Z]{{0,2}}-?\d{{1,5}}", True, words=("viatura", "vtr")),
    Detector("d22", "VIATURA", r"\b[A-Z]-?\d{5}\b", shapes=("run",)),
    Detector("d23", "PLACA", r"\b[A-Z]{3}-?\d[A-Z0-9]\d{2}\b"),
    Detector("d24", "REDE_SOCIAL", r"@[A-Za-z0-9._]{2,40}", False, "at", ("@",)),
    Detector("d25", "COORDENADA", r"\d{1,3}\s*°\s*\d{1,2}\s*['′]\s*[\d.]+\s*[\"″”]\s*[NSEWnsew]", words=("°",)),
    Detector("d26", "CEP", r"\b\d{5}-?\d{3}\b", shapes=("run",)),
    Detector(
        "d27", "ENDERECO",
        r"\b(?:Rua|R\.|Avenida|Av\.|Alameda|Al\.|Travessa|Trav\.|Estrada|Estr\.|Rodovia|Rod\.|Pra[çc]a|P[çc]\.|Viela|Vila|Largo)\s+"
        rf"[A-ZÀ-Ú][^\n,;]{{2,50}}(?:\s*,\s*{NUMERO}\d+)?", False, "street",
    ),
    Detector("d28", "CODIGO", r"\b[A-Z]{2,}\d{4,}\b|\b\d{4,}[A-Z]{1,3}\b"),
    Detector("d29", "CODIGO", r"\b\d{6,}\b", shapes=("run",)),
)
#: Sweeps, which leave legal citations alone.
SWEEPS = DETECTORS[27:]
# Citations, and labels whose adjacent repeats collapse, as the published scores know them.
LAW = r"(?:lei|decreto[-\s]?lei)\s*(?:(?:federal|estadual|municipal|complementar|n[.ºo°]*)\s*)*:?\s*[\d][\d.]+/\d{2,4}"
ARTICLE = r"\bart\.?\s*\d+[°ºª]?\s*(?:,?\s*(?:§|inciso|al[íi]nea|par[áa]grafo|caput)\s*[^,;.{law}]{{0,30}})?"
COLLAPSED = ("TELEFONE", "RG", "CPF", "IMEI", "DATA", "CODIGO", "BO", "VIATURA", "PLACA", "COORDENADA")
#: Letters that stand for citations during the sweeps; where a text holds them itself, they are kept as citations too.
LAW_MARK, ARTICLE_MARK = "ꙮ", "ꝏ"
GATES = {
    "digit": r"(?U)\d",
    "at": "@",
    "url": r"(?i)http|www\.",
    "protocol": r"(?iU)protocolo",
    "street": r"Rua|R\.|Av|Al|Tra|Est|Rod|P[rçc]|Vi|Largo",
}
#: Forms of digits that several detectors need.
SHAPES = {"run": r"\d{5}", "dots": r"\d\.\d{3}", "pair": r"\d{4}[-.\s]?\d{4}"}


def spans(text: Column, d: Detector) -> Column:
    return F.regexp_extract_all(text, F.lit(d.java), F.lit(0))


def replaced(text: Column, d: Detector) -> Column:
    return F.regexp_replace(text, d.java, f"[{d.label}]")


def law_pattern() -> str:
    return f"{LAW_MARK}|{LAW}"


def article_pattern() -> str:
    return f"{ARTICLE_MARK}|{ARTICLE.format(law=LAW_MARK)}"


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def restore(text: Column, mark: str, cited: Column) -> Column:
    """Puts citations back in the order in which they were taken out."""
    return F.array_join(F.zip_with(F.split(text, mark, -1), cited, lambda p, c: F.concat(p, F.coalesce(c, F.lit("")))), "")


def collapse(text: Column) -> Column:
    p = rf"(\[(?:{'|'.join(COLLAPSED)})\])(\s*\1)+"
    return F.when(is_ascii(text), F.regexp_replace(text, p, "$1")).otherwise(F.regexp_replace(text, "(?U)" + p, "$1"))


def squeeze(text: Column) -> Column:
    return F.when(text.contains("  "), F.regexp_replace(text, "  +", " ")).otherwise(text)


def detector_labels(detectors: tuple[Detector, ...] = DETECTORS) -> list[str]:
    return list(dict.fromkeys(d.label for d in detectors))


def _apart(value: Column) -> Column:
    """``value``, always. Not being deterministic, it keeps later filters from being moved below, each with its own chain."""
    return F.when(F.rand(0) >= 0.0, value)


def may_hold(text: Column, detectors: tuple[Detector, ...]) -> Column:
    """Whether any of the detectors can match in ``text`` at all, by their gates."""
    some = F.lit(False)
    for g in sorted({d.gate for d in detectors}):
        some = some | F.coalesce(text.rlike(GATES[g]), F.lit(False))
    return some


def stage1(df: DataFrame, text: str = "text", out: str = "stage1_text", captures: str = "captures", detectors: tuple[Detector, ...] = DETECTORS) -> DataFrame:
    """Adds the redacted text and the captures (label to spans, in detector order, then text order) of column ``text``.

    Null and blank texts give an empty text and no captures. Rows are independent: no shuffle. Each detector is a
    projection of its own on the former one's text, so that all are compiled together and none is worked out twice.
    ``detectors``: another list, in order; those with the codes of the sweeps run behind the citations' protection.
    """
    last = {d.code for d in SWEEPS}
    own = [F.col(f"`{c}`") for c in df.columns if c not in (out, captures)]
    t, none = F.col("__t"), F.array().cast("array<string>")
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    chain = df.select(*own, F.when(whole.rlike(r"(?U)[^\s\x1c-\x1f]"), whole).otherwise(F.lit("")).alias("__t"))
    # Gates are seen on the text as it was: labels end in a bracket, which stands in no form, so they open none.
    chain = chain.select("*", is_ascii(t).alias("__plain"), F.lower(t).alias("__low"))
    chain = chain.select("*", *[(F.col("__plain") & t.rlike(p)).alias(f"__{g}") for g, p in SHAPES.items()], *[t.rlike(p).alias(f"__{g}") for g, p in GATES.items()])

    def holds(words: tuple[str, ...], shapes: tuple[str, ...] = ()) -> Column:
        some = ~F.col("__plain")
        for x in [*[F.col("__low").contains(w) for w in words], *[F.col(f"__{g}") for g in shapes]]:
            some = some | x
        return some

    gated = [d for d in detectors if d.words or d.shapes]
    chain = chain.select("*", *[(F.col(f"__{d.gate}") & holds(d.words, d.shapes)).alias(f"__gate_{d.code}") for d in gated], holds(("lei",)).alias("__lei"), holds(("art",)).alias("__art"))

    def either(plain: str, full: str, f) -> Column:
        """``f`` of the pattern that the text needs."""
        return F.when(F.col("__plain"), f(plain)).otherwise(f(full))

    def found_all(p: str) -> Column:
        return F.regexp_extract_all(t, F.lit(p), F.lit(0))

    def detect(chain: DataFrame, d: Detector) -> DataFrame:
        """Texts without a match keep their string."""
        found = f"__{d.code}"
        gate = f"__gate_{d.code}" if d in gated else f"__{d.gate}"
        chain = chain.withColumn(found, F.when(F.col(gate), either(d.plain, d.java, found_all)).otherwise(none))
        done = either(d.plain, d.java, lambda p: F.regexp_replace(t, p, f"[{d.label}]"))
        return chain.withColumn("__t", F.when(F.size(found) > 0, done).otherwise(t))

    def protect(chain: DataFrame, name: str, gate: str, pattern: str, mark: str) -> DataFrame:
        """Takes citations out; their mark makes the text one beyond ASCII."""
        plain, full = "(?i)" + pattern, "(?iU)" + pattern
        chain = chain.withColumn(name, F.when((F.col("__digit") | t.contains(mark)) & F.col(gate), either(plain, full, found_all)).otherwise(none))
        chain = chain.withColumn("__t", F.when(F.size(name) > 0, either(plain, full, lambda p: F.regexp_replace(t, p, mark))).otherwise(t))
        return chain.withColumn("__plain", F.col("__plain") & (F.size(name) == 0))

    for d in [d for d in detectors if d.code not in last]:
        chain = detect(chain, d)
    chain = protect(chain, "__laws", "__lei", law_pattern(), LAW_MARK)
    chain = protect(chain, "__articles", "__art", article_pattern(), ARTICLE_MARK)
    for d in [d for d in detectors if d.code in last]:
        chain = detect(chain, d)
    for mark, cited in ((ARTICLE_MARK, "__articles"), (LAW_MARK, "__laws")):
        chain = chain.withColumn("__t", F.when(F.size(cited) > 0, restore(t, mark, F.col(cited))).otherwise(t))
    by_label = [F.concat(*[F.col(f"__{d.code}") for d in detectors if d.label == label]) for label in detector_labels(detectors)]
    found = F.map_from_arrays(F.array(*map(F.lit, detector_labels(detectors))), F.array(*by_label))
    return chain.select(*own, _apart(squeeze(collapse(t))).alias(out), _apart(F.map_filter(found, lambda _, v: F.size(v) > 0)).alias(captures))


def redact_column(df: DataFrame, column: str) -> DataFrame:
    """The table with one more column, ``"<column> [anonimizado]"``: detectors only, no validation; null becomes empty."""
    name = f"{column} [anonimizado]"
    out = stage1(df.select(F.col(f"`{column}`").alias("__in"), F.struct("*").alias("__row")), "__in", "__out", "__captures")
    return out.select("__row.*", F.col("__out").alias(name))


def label_hits(df: DataFrame, captures: str = "captures", key: str = "seq") -> DataFrame:
    """(label, spans, records): how often each label hit, in how many records."""
    return (
        df.select(key, F.explode_outer(captures).alias("label", "found"))  # outer: no filter to run the chain twice for
        .where("label is not null")
        .groupBy("label")
        .agg(F.sum(F.size("found")).cast("long").alias("spans"), F.countDistinct(key).alias("records"))
    )


def records_with_label(df: DataFrame, label: str, captures: str = "captures", key: str = "seq") -> DataFrame:
    """(key, spans) of the records in which ``label`` was captured."""
    return df.where(F.map_contains_key(captures, F.lit(label))).select(key, F.element_at(captures, F.lit(label)).alias("spans"))
