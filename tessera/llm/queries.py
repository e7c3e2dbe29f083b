"""The queries of this subpackage, with SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import embed_dedup, licenses, lm, mixing, packing, quality, topk, toxicity, warc
from .common import table
from .simhash import simhash_components


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), k=4, limit=4)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.topk(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0, k=5, scale=256.0)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), window=2048).drop("source")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"), share=1.5, cap=2.0, weights=(5, 2, 1))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages"), smallest=1000))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), cut=0.3)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), cut=0.7)


def queries() -> dict:
    return {
        "op1_simhash": op1_simhash,
        "op2_topk": op2_topk,
        "op3_licenses": op3_licenses,
        "op4_embed_dedup": op4_embed_dedup,
        "op5_packing": op5_packing,
        "op6_mixing": op6_mixing,
        "op7_warc": op7_warc,
        "op8_lm": op8_lm,
        "op9_quality": op9_quality,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict:
    return {"op2_topk": topk.ORACLE, "op6_mixing": mixing.ORACLE, "op7_warc": warc.ORACLE}
