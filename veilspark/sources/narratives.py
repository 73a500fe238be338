"""Narratives with known gold annotations, derived from ``orders`` by string and integer functions only.

The same SQL runs in Spark and in the oracle's engine, so both see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspark.sources.staging import spread

FIRST = "Joao,Maria,Pedro,Ana,Carlos,Lucia,Rafael,Beatriz"
LAST = "Almeida,Barbosa,Cardoso,Duarte,Esteves,Ferraz,Guedes,Hilario,Iglesias,Junqueira,Lacerda"
DISTRICTS = "Aurora,Bonanza,Cristal,Dourada,Esmeralda,Formosa,Gardenia"


def _pick(names: str, modulus: int) -> str:
    return f"split_part('{names}', ',', CAST(k % {modulus} AS INT) + 1)"


def _digits(expr: str, n: int) -> str:
    return f"lpad(CAST({expr} AS STRING), {n}, '0')"


NARRATIVES = f"""
WITH b AS (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders),
p AS (SELECT k, {_pick(FIRST, 8)} || ' ' || {_pick(LAST, 11)} AS nome,
  CASE WHEN k % 2 = 0 THEN 'Vila ' ELSE 'Jardim ' END || {_pick(DISTRICTS, 7)} AS bairro,
  CASE WHEN k % 3 = 0 THEN 'Rua ' || {_pick("Acacias,Begonias,Cravos,Dalias,Ervas", 5)} END AS rua,
  CASE WHEN k % 8 = 1 THEN {_digits("k * 7 % 1000", 3)} || '.' || {_digits("k * 11 % 1000", 3)} || '.' ||
    {_digits("k * 13 % 1000", 3)} || '-' || {_digits("k % 100", 2)} END AS cpf,
  CASE WHEN k % 40 = 3 THEN 'IML ' || CAST(10000 + k % 80000 AS STRING) END AS inst,
  CASE WHEN k % 12 = 5 THEN substr('ABCDEFGHJK', CAST(k % 10 AS INT) + 1, 1) || 'QZ-' || {_digits("k * 17 % 10000", 4)} END AS placa,
  CASE WHEN k % 10 = 0 THEN '(11) 9' || {_digits("k * 7919 % 10000", 4)} || '-' || {_digits("k * 104729 % 10000", 4)} END AS fone,
  CASE WHEN k % 25 = 7 THEN 'user' || CAST(k AS STRING) || '@mail.example.com' END AS email,
  CASE WHEN k % 30 = 11 THEN 'M-' || {_digits("k % 100000", 5)} END AS vtr,
  CASE WHEN k % 20 = 13 THEN {_pick("Tigrao,Russo,Faisca,Coruja", 4)} END AS vulgo
 FROM b)
SELECT k AS seq,
 'Em ' || {_digits("1 + k % 28", 2)} || '/' || {_digits("1 + k % 12", 2)} || '/2024, compareceu ' || nome ||
 ', relatando fato em ' || bairro || coalesce(', na ' || rua, '') || coalesce(', documento ' || cpf, '') ||
 coalesce(', laudo ' || inst, '') || coalesce(', veiculo ' || placa, '') || coalesce(', contato ' || fone, '') ||
 coalesce(', correio ' || email, '') || coalesce(', equipe ' || vtr, '') || coalesce(', autor conhecido como ' || vulgo, '') ||
 CASE WHEN k % 9 = 4 THEN ', conforme lei 11.343/2006 e art. 157 do codigo' ELSE '' END ||
 CASE WHEN k % 15 = 2 THEN ', lacre ' || CAST(7000000 + k AS STRING) ELSE '' END || '. Nada mais.' AS text,
 nome AS nomes, bairro || coalesce('; ' || rua, '') AS locais,
 CASE WHEN cpf IS NULL AND inst IS NULL THEN NULL ELSE concat_ws('; ', cpf, inst) END AS documentos,
 placa AS placas, fone AS telefones, email AS emails, vtr AS viaturas, vulgo AS vulgos
FROM p
"""

#: One form of every detector in turn, with a number of the order's own.
_FORMS = (
    "'acesse https://site.example.com/p' || k || ' hoje'",
    "'escreva a pessoa' || k || '@mail.example.com agora'",
    f"'autos {{0}}-12.2023.8.26.0100 conclusos'",
    "'processo no: ' || (100000 + k) || ' em curso'",
    "'protocolo: REQ' || (10000 + k) || ' aberto'",
    "'boletim de ocorrencia AB' || (1000 + k % 9000) || '/2023 lavrado'",
    "'oficio n. ' || (100 + k) || '/2024-ABC enviado'",
    "'codigo COPOM ' || (20000 + k) || ' anotado'",
    "'empresa {1}.{1}/0001-22 citada'",
    "'inscrito OAB/SP ' || (100000 + k) || ' presente'",
    "'aparelho IMEI 35757{2} levado'",
    "'portador CPF {3}-01 ouvido'",
    "'portador RG: {4}-X ouvido'",
    "'carteira CNH ' || (100000000 + k) || ' vencida'",
    "'ligou de +55 11 9{5}-1234 ontem'",
    "'celular: 9{5}-4321 desligado'",
    "'numero (21) 9{5}-9876 chamado'",
    "'aos ' || (1 + k % 28) || ' de agosto de 2023 ocorreu'",
    "'em {6}/07/2023 ocorreu'",
    "'em {6}.07.23 ocorreu'",
    "'viatura prefixo M {7} chegou'",
    "'apoio de Q-' || lpad(CAST(k % 100000 AS STRING), 5, '0') || ' chegou'",
    "'carro XYZ-' || lpad(CAST(k % 10000 AS STRING), 4, '0') || ' parado'",
    "'perfil @fulano' || (k % 1000) || ' visto'",
    "'ponto ' || (1 + k % 80) || '°' || (k % 60) || chr(39) || '12.5' || chr(34) || 'S visto'",
    "'bairro 0' || (1000 + k % 9000) || '-' || lpad(CAST(k % 1000 AS STRING), 3, '0') || ' visto'",
    "'mora na Avenida Brasil ' || (k % 100) || ', 45 fundos'",
    "'item ABCD' || (1000 + k) || ' levado'",
    "'lacre ' || (1000000 + k) || ' posto'",
    "'nada consta neste relato'",
)


def _forms() -> str:
    parts = {
        "{0}": "' || lpad(CAST(k % 10000000 AS STRING), 7, '0') || '", "{1}": "12.345.' || lpad(CAST(k % 1000 AS STRING), 3, '0') || '",
        "{2}": "' || lpad(CAST(k AS STRING), 10, '0') || '", "{3}": "' || (100 + k % 900) || '.456.789",
        "{4}": "' || (10 + k % 90) || '.345.678", "{5}": "' || lpad(CAST(k % 10000 AS STRING), 4, '0') || '",
        "{6}": "' || lpad(CAST(1 + k % 28 AS STRING), 2, '0') || '", "{7}": "' || (k % 1000) || '",
    }
    whens = []
    for i, form in enumerate(_FORMS):
        form = form.replace("{1}.{1}/", "12.345.' || lpad(CAST(k % 1000 AS STRING), 3, '0') || '/")
        for name, sql in parts.items():
            form = form.replace(name, sql)
        whens.append(f"WHEN {i} THEN {form}")
    return f"CASE CAST(k % {len(_FORMS)} AS INT) " + " ".join(whens) + " END"


def _cast_numbers(sql: str) -> str:
    """Numbers between bars are cast to text, as both engines want."""
    import re

    return re.sub(r"\|\| (\((?:[^()']|\([^()']*\))*\)|k)(?= \|\|)", r"|| CAST(\1 AS STRING)", sql)


PROBES = f"SELECT CAST(o_orderkey AS BIGINT) AS seq, {_cast_numbers(_forms())} AS text FROM (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) AS k FROM orders) o"
#: Stored mentions: names of four fifths of the records, nicknames of all.
MENTIONS = f"""
SELECT k AS seq, CASE WHEN k % 5 <> 0 THEN {_pick(FIRST, 8)} || ' ' || {_pick(LAST, 11)} END AS nome,
  CASE WHEN k % 20 = 13 THEN {_pick("Tigrao,Russo,Faisca,Coruja", 4)} END AS vulgo
FROM (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders) b
"""


def _from_orders(spark: SparkSession, sf_dir: str, sql: str, dealt: bool = False) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    return spark.sql(sql.replace("FROM orders", "FROM {orders}"), orders=spread(orders) if dealt else orders)


def narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_orders(spark, sf_dir, NARRATIVES, dealt=True)


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_orders(spark, sf_dir, PROBES, dealt=True)


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, category, idx, entity): entities stored by an earlier run."""
    from pyspark.sql import functions as F

    rows = _from_orders(spark, sf_dir, MENTIONS)
    kinds = F.array(F.struct(F.lit("nomes").alias("category"), F.col("nome").alias("entity")), F.struct(F.lit("vulgos").alias("category"), F.col("vulgo").alias("entity")))
    return rows.select("seq", F.posexplode(kinds).alias("idx", "m")).select("seq", "m.category", "idx", "m.entity").where("entity is not null")


def gazetteer_terms() -> list[tuple[str, str]]:
    """Dictionary for tests: misses one surname and one district, and holds one word that is no name."""
    names = [("nomes", f"{a} {b}") for a in FIRST.split(",") for b in LAST.split(",") if b != "Lacerda"]
    places = [("locais", f"Jardim {d}") for d in DISTRICTS.split(",") if d != "Formosa"]
    return [*names, *places, ("nomes", "Nada")]
