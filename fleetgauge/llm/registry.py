"""The operators of the training-data pipeline as registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetgauge.llm import ann, language, license_scan, line_dedup, packing, pieces, pii, quality, runs, sharding, simhash, token_counts, whitening
from fleetgauge.llm.common import ready
from fleetgauge.llm.oracles import ORACLES

#: Place of the byte-level vocabulary; its parameter is a path that every executor has.
def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def over_documents(report: Callable[..., DataFrame], **parameters) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        ready(spark)
        return report(documents(spark, folder), **{k: v() if callable(v) else v for k, v in parameters.items()})

    return query


def over_embeddings(report: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        ready(spark)
        return report(spark.read.parquet(f"{folder}/embeddings.parquet"))

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": over_documents(language.language_report),
        "op2_sentencepiece": over_documents(pieces.pieces_report, model=lambda: tokenizer("piece_bpe_32k.model")),
        "op3_pii_disclosure": over_documents(pii.pii_report),
        "op4_best_fit_packing": over_documents(packing.packing_report, tokenizer=tokenizer),
        "op5_simhash": over_documents(simhash.simhash_report),
        "op6_line_dedup": over_documents(line_dedup.line_report),
        "op7_quality_rules": over_documents(quality.quality_report),
        "op8_label_sharding": over_documents(sharding.sharding_report),
        "op9_collision_ann": over_embeddings(ann.ann_report),
        "op10_license_scan": over_documents(license_scan.license_report),
        "op11_whitening": over_embeddings(whitening.whitening_report),
        "op12_token_counts": over_documents(token_counts.tokens_report, tokenizer=tokenizer),
        "op13_periodic_runs": over_documents(runs.runs_report),
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
