"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import chat, decontaminate, embedding_forest, line_dedup, ngram_join, pii, pipeline, sentencepiece_bpe, suffixes, toxicity, zip_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": suffixes.op1,
        "op2_pii": pii.op2,
        "op3_sentencepiece": sentencepiece_bpe.op3,
        "op4_toxicity": toxicity.op4,
        "op5_embedding_dedup": embedding_forest.op5,
        "op6_ngram_join": ngram_join.op6,
        "op7_zip_warc": zip_warc.op7,
        "op8_chat": chat.op8,
        "op9_line_dedup": line_dedup.op9,
        "op10_decontaminate": decontaminate.op10,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    out = {"op8_chat": chat.SQL, "op9_line_dedup": line_dedup.SQL}
    if pipeline.ORACLE_SQL:
        out["pipeline"] = pipeline.ORACLE_SQL
    return out
