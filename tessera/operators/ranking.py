"""Ranking metrics with binary relevance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import fixed


def marked(ranked: DataFrame, relevant: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ranked with hit, queries with n_relevant) from pairs of query_id and chunk_id that are relevant."""
    pairs = relevant.select("query_id", "chunk_id").distinct()
    sizes = pairs.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    hits = ranked.join(pairs.withColumn("hit", F.lit(True)), ["query_id", "chunk_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return hits, queries.join(sizes, "query_id", "left")


def per_query(ranked: DataFrame, queries: DataFrame, k: int = fixed.EVAL_K) -> DataFrame:
    """query_id, precision, recall, mrr, ndcg and hit_rank (0 without a hit) of every query.

    ranked: query_id, rank, hit; queries: query_id, n_relevant. Precision divides by k even where fewer
    rows came back; the reciprocal rank looks at all rows that came back.
    """
    near = F.col("hit") & (F.col("rank") <= k)
    found = ranked.groupBy("query_id").agg(
        F.count(F.when(near, 1)).alias("hits"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"), F.sum(F.when(near, 1 / F.log2(F.col("rank") + 1))).alias("dcg")
    )
    least = F.least(F.col("n_relevant"), F.lit(k)).cast("int")
    ideal = F.aggregate(F.sequence(F.lit(1), least), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    some = F.col("n_relevant") > 0
    rows = queries.select("query_id", "n_relevant").join(found, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(
        "query_id", zero(F.col("hits") / k).alias("precision"), zero(F.when(some, F.col("hits") / F.col("n_relevant"))).alias("recall"),
        zero(1 / F.col("first")).alias("mrr"), zero(F.when(some, F.col("dcg") / ideal)).alias("ndcg"), F.coalesce("first", F.lit(0)).alias("hit_rank"),
    )


def macro(per: DataFrame, k: int = fixed.EVAL_K) -> DataFrame:
    """metric, value: means over queries to four places, with the share of queries that have a hit; 0 of no queries."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    one = per.agg(mean("precision").alias(f"precision@{k}"), mean("recall").alias(f"recall@{k}"), mean("mrr").alias("mrr"), mean("ndcg").alias(f"ndcg@{k}"), mean((F.col("hit_rank") > 0).cast("double")).alias("hit_rate"))
    return one.unpivot([], one.columns, "metric", "value")
