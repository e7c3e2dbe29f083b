"""Recall, rerank and citation of chunks for batches of questions."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import fixed, text


def top(rows: DataFrame, by: str, k: int, *order: Column | str, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, ranked from 1, in a total order."""
    n = F.row_number().over(W.partitionBy(by).orderBy(*order))
    return rows.withColumn(rank, n).where(F.col(rank) <= k)


def bm25(chunks: DataFrame, queries: DataFrame, k: int = fixed.TOP_RECALL, same: list[str] | None = None, query_text: str = "query") -> DataFrame:
    """query_id, chunk_id, score and rank of the k best chunks of each query with a positive score.

    chunks: chunk_id, tokens (of the text and its section) and the columns of `same`; queries: query_id, query_text and those. A
    query's repeated terms count each time. Statistics are over all chunks; a row of `same` keeps pairs of equal values, and a query's null there
    keeps all chunks.

    Only the query's terms leave the chunks' rows: postings are joined to terms and counted before
    any shuffle, so that what is shuffled grows with the matches.
    """
    same = same or []
    asked = queries.select("query_id", *[F.col(c).alias(f"_q_{c}") for c in same], F.explode(text.tokens(F.col(query_text))).alias("term"))
    asked = asked.groupBy("query_id", "term", *[f"_q_{c}" for c in same]).agg(F.count("*").alias("times"))
    terms = asked.select("term").distinct()
    # the texts are tokenised once: an empty term stands for each chunk as such, the query's terms for its postings
    every = chunks.select("chunk_id", *same, F.size("tokens").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "tokens")).alias("term"))
    kept_terms = terms.unionByName(terms.sparkSession.createDataFrame([("",)], "term string"))
    found = every.join(kept_terms, "term", "left_semi").groupBy("chunk_id", "dl", "term", *same).agg(F.count("*").cast("double").alias("tf")).persist(StorageLevel.DISK_ONLY)
    stats = found.where("term = ''").agg(F.count("*").alias("n"), F.coalesce(F.avg(F.col("dl").cast("double")), F.lit(0.0)).alias("avgdl"))
    postings = found.where("term <> ''")
    df = postings.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    idf = df.crossJoin(F.broadcast(stats)).select("term", F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), F.expr("if(avgdl = 0, 1, avgdl)").alias("avgdl"))
    part = F.col("tf") + fixed.BM25_K1 * (1 - fixed.BM25_B + fixed.BM25_B * F.col("dl") / F.col("avgdl"))
    weight = F.col("times") * F.col("idf") * F.col("tf") * (fixed.BM25_K1 + 1) / part
    kept = F.lit(True)
    for c in same:
        kept = kept & (F.col(f"_q_{c}").isNull() | (F.col(f"_q_{c}") == F.col(c)))
    scored = postings.join(idf, "term").join(asked, "term").where(kept).groupBy("query_id", "chunk_id").agg(F.sum(weight).alias("score"))
    return top(scored.where("score > 0"), "query_id", k, F.desc(F.round("score", 9)), "chunk_id")


#: Query vectors that are broadcast at most; beyond it blocks of queries and parts of the vectors meet by an equi-join.
BROADCAST_QUERIES, BLOCK_QUERIES, PARTS = 20_000, 1_000, 64


def dense(vectors: DataFrame, queries: DataFrame, k: int = fixed.TOP_RECALL) -> DataFrame:
    """query_id, chunk_id, score and rank by inner product of unit vectors: exact, over all vectors.

    vectors: chunk_id and vector; queries: query_id and vector. Few queries are broadcast, so that the vectors stay where they are. More
    than BROADCAST_QUERIES are cut into blocks, and the vectors into parts: each part meets each block under
    a key of its own, so that neither side has to fit in a task.
    """
    asked = queries.select("query_id", F.col("vector").alias("q"))
    n = asked.count()
    if n <= BROADCAST_QUERIES:
        pairs = vectors.join(F.broadcast(asked), F.col("chunk_id") != F.col("query_id"))
    else:
        part, block = F.pmod(F.xxhash64("chunk_id"), F.lit(PARTS)), F.pmod(F.xxhash64("query_id"), F.lit(-(-n // BLOCK_QUERIES)))
        left = vectors.withColumn("_part", part).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-n // BLOCK_QUERIES) - 1).cast("long"))))
        right = asked.withColumn("_block", block).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
        pairs = left.join(right, ["_part", "_block"]).where("chunk_id <> query_id")
    scored = pairs.select("query_id", "chunk_id", text.dot(F.col("vector"), F.col("q")).alias("score"))
    return top(scored, "query_id", k, F.desc(F.round("score", 9)), "chunk_id")


def lexical_rerank(recalled: DataFrame, chunks: DataFrame, queries: DataFrame, k: int = fixed.TOP_FINAL, query_text: str = "query") -> DataFrame:
    """query_id, chunk_id, score and rank: recalled chunks by the share of distinct query terms they hold.

    Recall order breaks ties, and stands where a query has no terms.
    """
    asked = queries.select("query_id", F.array_distinct(text.tokens(F.col(query_text))).alias("_terms"))
    rows = recalled.withColumnRenamed("rank", "_recall").withColumnRenamed("score", "_score").join(asked, "query_id").join(chunks.select("chunk_id", F.col("body_tokens").alias("_body")), "chunk_id")
    share = F.size(F.array_intersect("_terms", "_body")) / F.size("_terms")
    rows = rows.withColumn("score", F.when(F.size("_terms") > 0, share).otherwise(F.col("_score")))
    order = F.when(F.size("_terms") > 0, F.col("score")).otherwise(F.lit(0.0))
    return top(rows.withColumn("_order", order), "query_id", k, F.desc("_order"), "_recall").select("query_id", "chunk_id", "score", "rank")


def answers(queries: DataFrame, ranked: DataFrame, chunks: DataFrame, least: float = fixed.LEAST_SCORE, version: str = "lexical-bm25") -> DataFrame:
    """query_id, stub, low_confidence, summary, version and citations of every query.

    ranked: query_id, chunk_id, score, rank; chunks: chunk_id, clause_id, section_path, text. A query without
    hits, or with a top score below `least`, is a stub that quotes nothing.
    """
    cited = ranked.join(chunks.select("chunk_id", "clause_id", "section_path", "text"), "chunk_id")
    one = F.struct("rank", "clause_id", F.col("section_path").alias("section"), "text", F.round("score", 4).alias("score"))
    per = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("citations"), F.max_by("score", -F.col("rank")).alias("top_score"))
    low = F.coalesce(F.col("top_score") < least, F.lit(True))
    first = F.get("citations", F.lit(0))
    quoted = text.summary(first["clause_id"], first["section"], first["text"])
    return queries.select("query_id").join(per, "query_id", "left").select(
        "query_id", low.alias("stub"), low.alias("low_confidence"), F.when(low, F.lit(fixed.STUB_SUMMARY)).otherwise(quoted).alias("summary"),
        F.lit(version).alias("version"), F.coalesce("citations", F.array().cast(per.schema["citations"].dataType)).alias("citations"),
    )
