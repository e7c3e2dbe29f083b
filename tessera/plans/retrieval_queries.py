"""Queries of recall, rerank, citation and ranking evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import fixed, text
from tessera.operators import monitoring, ranking, retrieval

from .registry import query, table
from .text_queries import WINDOWS_SQL, tokens_sql


def chunk_table(spark, sf_dir):
    """Windowed chunks of documents: chunk_id, clause_id, section_path, lang, text, tokens (with the section) and body_tokens."""
    d = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    cut = d.select("doc_id", "source", "lang", F.posexplode(text.windows(F.col("text"))).alias("window", "piece"))
    clause = F.concat(F.coalesce("source", F.col("doc_id").cast("string")), F.lit(":root"))
    return cut.select(
        F.concat_ws(":", F.col("doc_id").cast("string"), F.col("window").cast("string")).alias("chunk_id"),
        F.when(F.col("window") > 0, F.concat(clause, F.lit("#"), F.col("window").cast("string"))).otherwise(clause).alias("clause_id"),
        F.lit("root").alias("section_path"), "lang", F.col("piece").alias("text"),
        text.tokens(F.concat("piece", F.lit(" root"))).alias("tokens"), text.tokens(F.col("piece")).alias("body_tokens"),
    )


def questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


CHUNKS_SQL = f"""src AS (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents), {WINDOWS_SQL},
  chunks AS (
    SELECT doc_id || ':' || win AS chunk_id, coalesce(source, doc_id::VARCHAR) || ':root' || CASE WHEN win > 0 THEN '#' || win ELSE '' END AS clause_id,
           'root' AS section_path, lang, piece AS text, {tokens_sql("piece || ' root'")} AS tokens, {tokens_sql("piece")} AS body_tokens FROM pieces),
  stats AS (SELECT count(*)::DOUBLE AS n, avg(len(tokens)) AS avgdl FROM chunks),
  posted AS (SELECT chunk_id, lang, len(tokens) AS dl, unnest(tokens) AS term FROM chunks),
  postings AS (SELECT chunk_id, lang, dl, term, count(*)::DOUBLE AS tf FROM posted GROUP BY ALL),
  df AS (SELECT term, count(*)::DOUBLE AS df FROM postings GROUP BY term)"""

BM25_SQL = f"""{CHUNKS_SQL},
  asked AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({tokens_sql("text")}) AS term FROM benchmark) GROUP BY ALL),
  scored AS (
    SELECT query_id, chunk_id, any_value(lang) AS lang, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
    FROM postings JOIN df USING (term) JOIN asked USING (term), stats GROUP BY query_id, chunk_id)"""


@query(
    "retrieval_bm25_topk",
    f"""WITH {BM25_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id)::INT AS rank FROM scored)
    SELECT query_id, rank, chunk_id, round(score, 4) AS score FROM ranked WHERE rank <= 6""",
)
def retrieval_bm25_topk(spark, sf_dir):
    best = retrieval.bm25(chunk_table(spark, sf_dir), questions(spark, sf_dir), k=fixed.TOP_FINAL)
    return best.select("query_id", "rank", "chunk_id", F.round("score", 4).alias("score"))


@query(
    "retrieval_bm25_by_lang",
    f"""WITH {BM25_SQL}, kept AS (SELECT * FROM scored WHERE lang = ['en', 'de', 'fr', 'es'][(query_id % 4 + 1)::INT]),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id)::INT AS rank FROM kept)
    SELECT query_id, rank, chunk_id, round(score, 4) AS score FROM ranked WHERE rank <= 50""",
)
def retrieval_bm25_by_lang(spark, sf_dir):
    """Each question asks for one language; the statistics stay those of all chunks."""
    q = questions(spark, sf_dir).withColumn("lang", F.element_at(F.array(*map(F.lit, ["en", "de", "fr", "es"])), (F.col("query_id") % 4 + 1).cast("int")))
    best = retrieval.bm25(chunk_table(spark, sf_dir), q, k=fixed.TOP_RECALL, same=["lang"])
    return best.select("query_id", "rank", "chunk_id", F.round("score", 4).alias("score"))


RERANK_SQL = f"""{BM25_SQL},
  recalled AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS recall FROM scored QUALIFY recall <= 50),
  terms AS (SELECT item_id AS query_id, list_distinct({tokens_sql("text")}) AS q FROM benchmark),
  shared AS (SELECT r.query_id, r.chunk_id, recall, len(list_intersect(q, body_tokens)) / len(q)::DOUBLE AS score FROM recalled r JOIN terms USING (query_id) JOIN chunks USING (chunk_id)),
  ranked AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, recall)::INT AS rank FROM shared QUALIFY rank <= 6)"""


def reranked(spark, sf_dir):
    c, q = chunk_table(spark, sf_dir), questions(spark, sf_dir)
    return c, q, retrieval.lexical_rerank(retrieval.bm25(c, q), c, q)


@query("retrieval_lexical_rerank", f"WITH {RERANK_SQL} SELECT query_id, rank, chunk_id, round(score, 4) AS score FROM ranked")
def retrieval_lexical_rerank(spark, sf_dir):
    return reranked(spark, sf_dir)[2].select("query_id", "rank", "chunk_id", F.round("score", 4).alias("score"))


@query(
    "coverage_answers",
    f"""WITH {RERANK_SQL},
    first AS (SELECT query_id, score, clause_id, trim(replace(text, E'\\n', ' '), ' ') AS flat FROM ranked JOIN chunks USING (chunk_id) WHERE rank = 1),
    n AS (SELECT query_id, count(*) AS n FROM ranked GROUP BY query_id)
    SELECT item_id AS query_id, coalesce(score < 0.2, true) AS stub, coalesce(n, 0)::INT AS n_citations,
           CASE WHEN coalesce(score < 0.2, true) THEN '{fixed.STUB_SUMMARY}'
                ELSE 'Laut ' || clause_id || ' (root): ' || CASE WHEN length(flat) > 240 THEN regexp_replace(left(flat, 240), ' [^ ]*$', '') || '…' ELSE flat END END AS summary
    FROM benchmark LEFT JOIN first ON query_id = item_id LEFT JOIN n ON n.query_id = item_id""",
)
def coverage_answers(spark, sf_dir):
    c, q, ranked = reranked(spark, sf_dir)
    a = retrieval.answers(q, ranked, c)
    return a.select("query_id", "stub", F.size("citations").alias("n_citations"), "summary")


@query("index_stats", f"WITH {CHUNKS_SQL} SELECT term, df::BIGINT AS df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf, round(avgdl, 4) AS avgdl, n::BIGINT AS n FROM df, stats")
def index_stats(spark, sf_dir):
    """Document frequency and weight of every term, over all chunks."""
    c = chunk_table(spark, sf_dir)
    stats = c.agg(F.count("*").alias("n"), F.round(F.avg(F.size("tokens").cast("double")), 4).alias("avgdl"))
    df = c.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(stats)).select("term", "df", F.round(F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"), "avgdl", "n")


DENSE_SQL = """
  pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score, q.label = c.label AS hit
            FROM embeddings q JOIN embeddings c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id)::INT AS rank FROM pairs QUALIFY rank <= 50)"""


def dense_ranked(spark, sf_dir):
    """The stated queries, every hundredth vector, against all vectors."""
    e = table(spark, sf_dir, "embeddings")
    v = e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("q_label"))
    ranked = retrieval.dense(v, q).join(v.select("chunk_id", "label"), "chunk_id").join(q.select("query_id", "q_label"), "query_id")
    return ranked.withColumn("hit", F.col("label") == F.col("q_label")), q, e


@query("retrieval_dense_topk", f"WITH {DENSE_SQL} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM ranked")
def retrieval_dense_topk(spark, sf_dir):
    return dense_ranked(spark, sf_dir)[0].select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


METRICS_SQL = f"""WITH {DENSE_SQL},
  six AS (SELECT * FROM ranked WHERE rank <= 6),
  rel AS (SELECT q.vec_id AS query_id, (SELECT count(*) FROM embeddings c WHERE c.label = q.label) - 1 AS n FROM embeddings q WHERE q.vec_id % 100 = 0),
  per AS (
    SELECT rel.query_id, count(*) FILTER (hit AND rank <= 5) / 5.0::DOUBLE AS precision, coalesce(count(*) FILTER (hit AND rank <= 5) / nullif(any_value(n), 0)::DOUBLE, 0) AS recall,
           coalesce(1 / min(rank) FILTER (hit)::DOUBLE, 0) AS mrr,
           coalesce(sum(1 / log2(rank + 1)) FILTER (hit AND rank <= 5), 0) / list_sum(list_transform(range(1, least(any_value(n), 5) + 1), lambda i: 1 / log2(i + 1))) AS ndcg,
           coalesce(min(rank) FILTER (hit), 0)::INT AS hit_rank
    FROM rel LEFT JOIN six USING (query_id) GROUP BY rel.query_id)"""


def dense_metrics(spark, sf_dir):
    ranked, q, e = dense_ranked(spark, sf_dir)
    sizes = e.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    return ranking.per_query(ranked.where(F.col("rank") <= fixed.TOP_FINAL), q.join(sizes, F.col("q_label") == F.col("label")))


@query("ranking_per_query", f"{METRICS_SQL} SELECT query_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg, hit_rank FROM per")
def ranking_per_query(spark, sf_dir):
    p = dense_metrics(spark, sf_dir)
    return p.select("query_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "mrr", "ndcg")], "hit_rank")


MACRO_SQL = """UNPIVOT (SELECT round(avg(precision), 4) AS "precision@5", round(avg(recall), 4) AS "recall@5", round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS "ndcg@5", round(avg((hit_rank > 0)::INT), 4) AS hit_rate FROM per)
    ON COLUMNS(*) INTO NAME metric VALUE value"""


@query("ranking_macro", f"{METRICS_SQL} SELECT metric, value FROM ({MACRO_SQL})")
def ranking_macro(spark, sf_dir):
    return ranking.macro(dense_metrics(spark, sf_dir))


@query(
    "shadow_evaluation",
    f"""{METRICS_SQL}, old AS (SELECT metric, value FROM ({MACRO_SQL})),
    new AS (SELECT metric, round(value - CASE WHEN metric = 'mrr' THEN 0.005 ELSE 0.02 END, 4) AS value FROM old)
    SELECT metric, o.value AS old, n.value AS new, round(n.value - o.value, 6) AS delta, metric = 'mrr' OR starts_with(metric, 'ndcg') AS gated,
           NOT (metric = 'mrr' OR starts_with(metric, 'ndcg')) OR round(o.value - n.value, 9) <= 0.01 AS passed
    FROM old o JOIN new n USING (metric)""",
)
def shadow_evaluation(spark, sf_dir):
    """The dense metrics against a candidate that is somewhat worse."""
    old = ranking.macro(dense_metrics(spark, sf_dir))
    new = old.select("metric", F.round(F.col("value") - F.when(F.col("metric") == "mrr", 0.005).otherwise(0.02), 4).alias("value"))
    return monitoring.shadow(old, new)
