"""Drift of traces, the evaluation gate, prompt registry and index migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import fixed

from .claims import literal_map


def newest(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The n newest rows with their place (1 the newest); a top-n before the numbering, so that only n rows meet in one task."""
    return rows.orderBy(*order).limit(n).withColumn("place", F.row_number().over(W.orderBy(*order)))


def two_windows(traces: DataFrame, window: int, *order: Column) -> DataFrame:
    """traces of the newest window and of the one before, tagged recent and reference; no rows if there are fewer than both hold."""
    rows = newest(traces, 2 * window, *order).withColumn("part", F.when(F.col("place") <= window, "recent").otherwise("reference"))
    return rows.withColumn("_all", F.count("*").over(W.partitionBy())).where(F.col("_all") == 2 * window).drop("_all")


def psi(rows: DataFrame, value: str, bins: int = fixed.PSI_BINS) -> DataFrame:
    """One row psi: population stability of recent against reference values, in bins of the reference's quantiles.

    Null values are left out; 0 if either part is empty or its quantiles leave fewer than two bins.
    """
    v = rows.where(F.col(value).isNotNull()).select("part", F.col(value).cast("double").alias("v"))
    cuts = [i / bins for i in range(1, bins)]
    edges = v.where("part = 'reference'").agg(F.array_sort(F.array_distinct(F.percentile("v", F.array(*map(F.lit, cuts))))).alias("edges"))
    per = v.join(F.broadcast(edges), F.lit(True)).withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col("v"))))
    n = per.groupBy("bin", "edges").agg(F.count(F.when(F.col("part") == "reference", 1)).alias("ref"), F.count(F.when(F.col("part") == "recent", 1)).alias("rec"))
    whole = W.partitionBy()
    n = n.withColumn("a", F.col("ref") / F.sum("ref").over(whole)).withColumn("b", F.col("rec") / F.sum("rec").over(whole))
    term = (F.col("b") - F.col("a")) * F.ln((F.col("b") + fixed.PSI_EPS) / (F.col("a") + fixed.PSI_EPS))
    return n.where(F.size("edges") >= 1).agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("psi"))


def drift(traces: DataFrame, window: int, *order: Column, grounded: str = "groundedness", score: str = "top_score") -> DataFrame:
    """metric, reference, recent, delta and drift; no rows while there is nothing to compare with."""
    rows = two_windows(traces, window, *order)
    mean = lambda part: F.coalesce(F.avg(F.when(F.col("part") == part, F.col(grounded))), F.lit(0.0))
    g = rows.groupBy(F.lit(1).alias("_one")).agg(mean("reference").alias("reference"), mean("recent").alias("recent"))
    fell = (F.col("recent") < fixed.GROUNDED_FLOOR) | (F.col("reference") - F.col("recent") > fixed.GROUNDED_DROP)
    first = g.select(F.lit("groundedness_rate").alias("metric"), "reference", "recent", (F.col("recent") - F.col("reference")).alias("delta"), fell.alias("drift"))
    p = psi(rows, score).join(g.select("_one"), F.lit(True))
    second = p.select(F.lit("retrieval_score_psi").alias("metric"), F.lit(0.0).alias("reference"), F.col("psi").alias("recent"), F.col("psi").alias("delta"), (F.col("psi") > fixed.PSI_DRIFT).alias("drift"))
    return first.unionByName(second)


def tolerance(metric: Column) -> Column:
    return literal_map(fixed.TOLERANCES)[F.split_part(metric, F.lit("@"), F.lit(1))]


def regressions(current: DataFrame, baseline: DataFrame, strict: bool = False) -> DataFrame:
    """metric, value, baseline and reason of what fails: drops beyond tolerance and, if strict, gated metrics not measured."""
    b = baseline.withColumnRenamed("value", "baseline").withColumn("_tol", tolerance(F.col("metric"))).where("_tol IS NOT NULL")
    both = b.join(current, "metric")
    out = both.where("baseline - value > _tol").select("metric", "value", "baseline", F.lit("drop").alias("reason"))
    if strict:
        out = out.unionByName(b.join(current, "metric", "left_anti").select("metric", F.lit(None).cast("double").alias("value"), "baseline", F.lit("not measured").alias("reason")))
    return out


def provenance_changes(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """key, now and was, of the keys that the baseline has and that differ now (key, value)."""
    keys = baseline.where(F.col("key").isin(fixed.PROVENANCE_KEYS)).withColumnRenamed("value", "was")
    return keys.join(current.withColumnRenamed("value", "now"), "key", "left").where(~F.col("now").eqNullSafe(F.col("was"))).select("key", "now", "was")


def comparable(current: DataFrame, changes: DataFrame) -> DataFrame:
    """current without judged metrics, where another judge scored the baseline."""
    judged = changes.where(F.col("key").isin("judge_backend", "judge_model")).select(F.lit("groundedness").alias("metric")).distinct()
    return current.join(judged, "metric", "left_anti")


def family(backend: Column, model: Column) -> Column:
    """Model family of a backend; of a local server's by the model's name."""
    head = F.lower(F.split_part(model, F.lit(":"), F.lit(1)))
    named = F.lit("local-oss")
    for key, name in reversed(fixed.MODEL_FAMILIES.items()):
        named = F.when(F.contains(head, F.lit(key)), F.lit(name)).otherwise(named)
    local = (backend == "ollama") & F.coalesce(model != "", F.lit(False))
    return F.when(local, named).otherwise(F.coalesce(literal_map(fixed.BACKEND_FAMILIES)[backend], backend))


def prompt_refs(prompts: DataFrame) -> DataFrame:
    """prompts (name, version, template, active) with content_hash, ref, and whether just one version of the name is active."""
    digest = F.substring(F.sha2("template", 256), 1, 12)
    one = F.sum(F.col("active").cast("int")).over(W.partitionBy("name")) == 1
    return prompts.withColumn("content_hash", digest).withColumn("ref", F.concat("name", F.lit("@"), "version", F.lit("+"), "content_hash")).withColumn("single_active", one)


def active_prompt(prompts: DataFrame, name: str, version: str | None = None):
    """The row of a version, or of the one active version; an error if there is no such row."""
    own = prompt_refs(prompts.where(F.col("name") == name))
    rows = own.where(F.col("version") == version if version else F.col("active")).limit(2).collect()
    if len(rows) != 1:
        raise LookupError(f"{name}: {len(rows)} rows of version {version or 'active'}, one is wanted")
    return rows[0]


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows in place of those of equal keys; keys are distinct in each."""
    return old.join(new, keys, "left_anti").unionByName(new)


def coverage(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """version, covered and total: how many chunks have a vector of each version."""
    total = chunks.agg(F.count("*").alias("total"))
    have = vectors.join(chunks.select("id"), "id", "left_semi").groupBy("version").agg(F.count_distinct("id").alias("covered"))
    return have.crossJoin(F.broadcast(total)).select("version", "covered", "total")


def missing(chunks: DataFrame, vectors: DataFrame, version: str) -> DataFrame:
    """chunks without a vector of the version: what a backfill has to embed."""
    return chunks.join(vectors.where(F.col("version") == version).select("id"), "id", "left_anti")


def shadow(old: DataFrame, new: DataFrame, tolerance: float = fixed.SHADOW_TOLERANCE) -> DataFrame:
    """metric, old, new, delta, gated and passed of two versions' metrics; only nDCG and the reciprocal rank gate."""
    both = old.withColumnRenamed("value", "old").join(new.withColumnRenamed("value", "new"), "metric")
    gated = F.startswith("metric", F.lit("ndcg")) | (F.col("metric") == "mrr")
    return both.select("metric", "old", "new", F.round(F.col("new") - F.col("old"), 6).alias("delta"), gated.alias("gated"), (~gated | (F.round(F.col("old") - F.col("new"), 9) <= tolerance)).alias("passed"))
