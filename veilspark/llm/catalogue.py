"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

import corpus_pipeline
from veilspark.llm import (
    bpe,
    centroids,
    decontaminate,
    exact_dedup,
    html_extract,
    license_scan,
    line_dedup,
    merkle,
    minhash_dedup,
    secret_scan,
    simhash_dedup,
    toxicity,
    url_filter,
)


def queries() -> dict:
    return {
        "op1_secret_scan": secret_scan.op1_secret_scan,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_url_filter": url_filter.op3_url_filter,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_bpe": bpe.op6_bpe,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_html_extract": html_extract.op8_html_extract,
        "op9_license_scan": license_scan.op9_license_scan,
        "op10_simhash": simhash_dedup.op10_simhash,
        "op11_minhash": minhash_dedup.op11_minhash,
        "op12_merkle": merkle.op12_merkle,
        "op13_centroids": centroids.op13_centroids,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scan": secret_scan.SQL,
        "op4_exact_dedup": exact_dedup.SQL,
        "op7_line_dedup": line_dedup.SQL,
        "op12_merkle": merkle.SQL,
        "op13_centroids": centroids.SQL,
    }
