"""The queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_language_id, op2_mixing, op3_licenses, op4_topk, op5_packing, op6_simhash, op7_tokens, op8_toxicity, op9_fingerprints, op10_line_dedup, op11_filter_audit, op12_lexical_search, op13_decontamination


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id.query,
        "op2_mixing": op2_mixing.query,
        "op3_licenses": op3_licenses.query,
        "op4_topk": op4_topk.query,
        "op5_packing": op5_packing.query,
        "op6_simhash": op6_simhash.query,
        "op7_tokens": op7_tokens.query,
        "op8_toxicity": op8_toxicity.query,
        "op9_fingerprints": op9_fingerprints.query,
        "op10_line_dedup": op10_line_dedup.query,
        "op11_filter_audit": op11_filter_audit.query,
        "op12_lexical_search": op12_lexical_search.query,
        "op13_decontamination": op13_decontamination.query,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_licenses": op3_licenses.ORACLE, "op4_topk": op4_topk.ORACLE, "op11_filter_audit": op11_filter_audit.ORACLE, "op12_lexical_search": op12_lexical_search.ORACLE, "op13_decontamination": op13_decontamination.ORACLE}
