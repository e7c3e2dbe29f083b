"""Readers of corpus files, golden sets, profiles, domains, scenarios, prompts and baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import chunking

GOLDEN = "query string, relevant_clause_ids array<string>, product_code string, lang string, difficulty string, note string"
DOMAIN = (
    "id string, name string, role_label string, role_description string, opening_template string, "
    "targets array<struct<id: string, descriptor: string>>, fraud_signals array<string>, escalations array<string>, tools array<string>, tone_notes string"
)
SCENARIO = "name string, domain string, crm_profile string, expected_pillars array<string>, expected_fraud_signals array<string>, caller_turns array<string>"
TRACE = (
    "trace_id string, ts double, prompt_ref string, retrieved_ids array<string>, response string, embedding_version string, "
    "latency_ms double, prompt_tokens int, completion_tokens int, groundedness double, top_score double"
)


def whole_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, raw) of the files of a folder that match; an error if there is none."""
    files = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    if files.isEmpty():
        raise FileNotFoundError(f"no {pattern} files in {folder}")
    return files


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a folder of Markdown files with front matter."""
    return chunking.documents(whole_files(spark, folder, "*.md"))


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden queries of a JSON-lines file; blank lines are skipped, lang is de where missing."""
    rows = spark.read.schema(GOLDEN).json(path).where("query IS NOT NULL")
    return rows.withColumn("lang", F.coalesce("lang", F.lit("de")))


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """name, profile (variant) and the fields that all products have, of customer profiles."""
    v = F.parse_json("raw")
    get = lambda *paths: F.coalesce(*[F.try_variant_get("profile", p, "string") for p in paths])
    rows = whole_files(spark, folder, "*.json").select(F.regexp_extract("path", r"([^/]*)\.json$", 1).alias("name"), v.alias("profile"))
    return rows.select(
        "name", "profile", get("$.caller_id").alias("caller_id"), get("$.policyholder.name", "$.policyholder.contact_person", "$.customer.name").alias("holder"),
        get("$.policyholder.phone").alias("phone"), get("$.policy.policy_number").alias("policy_number"), get("$.policy.product").alias("product"),
    )


def domains(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(DOMAIN).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder).where("id IS NOT NULL")


def domain_targets(domains: DataFrame) -> DataFrame:
    """id, seq, target and descriptor of each domain's targets."""
    return domains.select("id", F.posexplode("targets").alias("seq", "t")).select("id", "seq", F.col("t.id").alias("target"), "t.descriptor")


def scenarios(spark: SparkSession, folder: str) -> DataFrame:
    """Scenarios with the domain they default to."""
    rows = spark.read.schema(SCENARIO).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return rows.withColumn("domain", F.coalesce("domain", F.lit("insurance_fnol")))


def scenario_turns(scenarios: DataFrame) -> DataFrame:
    return scenarios.select("name", F.posexplode("caller_turns").alias("turn", "text"))


def prompts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """name, version, template and active of the prompt files name.*.yaml: scalars and one block."""
    raw = F.col("raw")
    scalar = lambda k: F.regexp_replace(F.regexp_extract(raw, rf"(?m)^{k}:[ \t]*(.*?)[ \t]*$", 1), r"""^(['"])(.*)\1$""", "$2")
    block = F.regexp_extract(raw, r"(?ms)^template:[ \t]*\|[-+]?[ \t]*\n((?:[ \t]+[^\n]*\n?|\n)*)", 1)
    text = F.regexp_replace(block, r"(?m)^  ", "")
    return whole_files(spark, folder, f"{name}.*.yaml").select(
        scalar("name").alias("name"), scalar("version").alias("version"), F.when(block != "", text).otherwise(scalar("template")).alias("template"), (F.lower(scalar("active")) == "true").alias("active"),
    )


def baseline(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(metrics, provenance) as name and value; an old flat file is all metrics."""
    doc = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("d"))
    pairs = lambda v, kind: doc.select(F.explode(F.from_json(F.to_json(v), T.MapType(T.StringType(), kind))).alias("k", "value"))
    has = F.variant_get("d", "$.metrics", "variant")
    metrics = doc.select(F.explode(F.from_json(F.coalesce(F.to_json(has), F.to_json("d")), "map<string,double>")).alias("metric", "value")).where("value IS NOT NULL")
    provenance = pairs(F.try_variant_get("d", "$.provenance", "variant"), T.StringType()).withColumnRenamed("k", "key")
    return metrics, provenance


def training_rows(spark: SparkSession, path: str, least: int = 5) -> DataFrame:
    """Training examples of a JSON-lines file; an error for fewer than `least`."""
    rows = spark.read.schema("tokenized_text array<string>, ner array<array<string>>").json(path).where("tokenized_text IS NOT NULL")
    if rows.limit(least).count() < least:
        raise ValueError(f"fewer than {least} examples in {path}")
    return rows


def newest_file(spark: SparkSession, folder: str, pattern: str = "*") -> str | None:
    """The path that was written last."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")
    return files.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]


def clips(spark: SparkSession, path: str) -> DataFrame:
    """category, clip id and text of a manifest of categories with items."""
    one = "struct<id: string, text: string>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(F.get_json_object("value", "$.categories"), f"map<string,array<{one}>>")).alias("category", "items"))
    return rows.select("category", F.explode("items").alias("c")).select("category", "c.id", "c.text")
