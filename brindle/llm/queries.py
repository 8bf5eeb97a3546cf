"""The operators' queries over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, fim, jaccard, langid, licenses, lines, mixing, neardup, tokenops, toxicity, whitening
from .common import load


def op10(docs: DataFrame) -> DataFrame:
    """Every document's near-copy group: 3-word shingles, Jaccard similarity of 0.9 or more."""
    return jaccard.jaccard_groups(docs.select("doc_id", "text"), words=3, percent=90)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _on_documents(op: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: op(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": _on_documents(langid.op1),
        "op2_mixing": _on_documents(mixing.op2),
        "op3_token_files": _on_documents(tokenops.op3),
        "op4_toxicity": lambda spark, sf_dir: toxicity.op4(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")),
        "op5_token_counts": _on_documents(tokenops.op5),
        "op6_line_dedup": _on_documents(lines.op6),
        "op7_nearest_neighbours": lambda spark, sf_dir: ann.op7(load(spark, sf_dir, "embeddings")),
        "op8_bpe": _on_documents(tokenops.op8),
        "op9_embedding_near_dedup": lambda spark, sf_dir: neardup.op9(load(spark, sf_dir, "embeddings")),
        "op10_jaccard_join": _on_documents(op10),
        "op11_fill_in_middle": _on_documents(fim.op11),
        "op12_embedding_whitening": lambda spark, sf_dir: whitening.op12(load(spark, sf_dir, "embeddings")),
        "op13_license_scan": _on_documents(licenses.op13),
        "pipeline": pipeline,
    }


#: What SQL can say of these operators' rows in full. Op10 has quadratic pairs, which DuckDB can't do on
#: whole tables in time; most others learn, draw, encode, turn or hash: those are tested against brute force.
ORACLE: dict[str, str] = {"op11_fill_in_middle": fim.SQL, "op13_license_scan": licenses.SQL}
