import hashlib
import unicodedata

from veilspark.jobs import catalogue


def plain(text):
    d = unicodedata.normalize("NFKD", text.strip().lower())
    return "".join(c for c in d if (c.isalnum() or c == "_") and not unicodedata.combining(c))


def test_documents_with_accents_are_normalised(spark, tmp_path):
    texts = ["São João, 2ª via nº 5", "AÇÃO É ÚNICA", "é combinado", "Größe Ñandú über", "plain ASCII_text.", "１２ x", "日本 語", "Ελλάδα", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.norm_md5 for r in catalogue.QUERIES["normalize_text_all"](spark, str(tmp_path)).collect()}
    assert got == {i: t if t is None else hashlib.md5(plain(t).encode()).hexdigest() for i, t in enumerate(texts)}
