"""Queries of drift, histories, the gate, provenance, prompts and index upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import fixed, rules, text
from tessera.operators import monitoring

from .registry import query, table

def newest_first() -> list:
    return [F.desc("ts"), F.desc("event_id")]


TRACES_SQL = """traces AS (SELECT event_id, ts, CASE WHEN event_id % 11 = 0 THEN NULL ELSE (event_id * 37 % 100) / 100.0::DOUBLE END AS groundedness, value AS top_score FROM events),
  placed AS (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS place FROM traces),
  two AS (SELECT *, CASE WHEN place <= 200 THEN 'recent' ELSE 'reference' END AS part FROM placed WHERE place <= 400),
  v AS (SELECT part, top_score AS v FROM two WHERE top_score IS NOT NULL),
  e AS (SELECT list_sort(list_distinct(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS edges FROM v WHERE part = 'reference'),
  b AS (SELECT part, len(list_filter(edges, lambda x: x <= v)) AS bin FROM v, e),
  n AS (SELECT bin, count(*) FILTER (part = 'reference') AS ref, count(*) FILTER (part = 'recent') AS rec FROM b GROUP BY bin),
  f AS (SELECT bin, ref / sum(ref) OVER ()::DOUBLE AS a, rec / sum(rec) OVER ()::DOUBLE AS b FROM n),
  p AS (SELECT sum((b - a) * ln((b + 1e-6::DOUBLE) / (a + 1e-6::DOUBLE))) AS psi FROM f)"""


def traces(spark, sf_dir):
    """Events as traces: value is the top score, groundedness is made from the id."""
    grounded = F.when(F.col("event_id") % 11 != 0, (F.col("event_id") * 37 % 100) / 100)
    return table(spark, sf_dir, "events").select("event_id", "ts", grounded.alias("groundedness"), F.col("value").alias("top_score"))


@query(
    "drift_report",
    f"""WITH {TRACES_SQL}, g AS (SELECT avg(groundedness) FILTER (part = 'reference') AS ref, avg(groundedness) FILTER (part = 'recent') AS rec FROM two)
    SELECT 'groundedness_rate' AS metric, round(ref, 6) AS reference, round(rec, 6) AS recent, round(rec - ref, 6) AS delta, rec < 0.9 OR ref - rec > 0.05 AS drift FROM g
    UNION ALL SELECT 'retrieval_score_psi', 0.0::DOUBLE, round(psi, 6), round(psi, 6), psi > 0.2 FROM p""",
)
def drift_report(spark, sf_dir):
    d = monitoring.drift(traces(spark, sf_dir), fixed.DRIFT_WINDOW, *newest_first())
    return d.select("metric", *[F.round(c, 6).alias(c) for c in ("reference", "recent", "delta")], "drift")


@query("drift_windows", f"WITH {TRACES_SQL} SELECT event_id, place::INT AS place, part FROM two")
def drift_windows(spark, sf_dir):
    return monitoring.two_windows(traces(spark, sf_dir), fixed.DRIFT_WINDOW, *newest_first()).select("event_id", "place", "part")


@query("drift_too_few_rows", f"WITH {TRACES_SQL}, few AS (SELECT * FROM traces WHERE event_id IN (SELECT min(event_id) FROM events)) SELECT event_id, 1::INT AS place, 'recent' AS part FROM few WHERE (SELECT count(*) FROM few) > 1")
def drift_too_few_rows(spark, sf_dir):
    """The two windows of a single trace, the oldest id's: too few rows to compare, at any size of the table."""
    rows = traces(spark, sf_dir)
    one = rows.join(rows.agg(F.min("event_id").alias("event_id")), "event_id", "left_semi")
    return monitoring.two_windows(one, fixed.DRIFT_WINDOW, *newest_first()).select("event_id", "place", "part")


@query(
    "psi_by_type",
    """WITH v AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'recent' ELSE 'reference' END AS part, value * CASE WHEN user_id % 2 = 0 THEN 1.2::DOUBLE ELSE 1 END AS v FROM events WHERE value IS NOT NULL),
    e AS (SELECT list_sort(list_distinct(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS edges FROM v WHERE part = 'reference'),
    n AS (SELECT len(list_filter(edges, lambda x: x <= v)) AS bin, count(*) FILTER (part = 'reference') AS ref, count(*) FILTER (part = 'recent') AS rec FROM v, e GROUP BY bin),
    f AS (SELECT ref / sum(ref) OVER ()::DOUBLE AS a, rec / sum(rec) OVER ()::DOUBLE AS b FROM n)
    SELECT round(sum((b - a) * ln((b + 1e-6::DOUBLE) / (a + 1e-6::DOUBLE))), 6) AS psi FROM f""",
)
def psi_by_type(spark, sf_dir):
    """Values of even users, raised by a fifth, against those of odd users."""
    even = F.col("user_id") % 2 == 0
    rows = table(spark, sf_dir, "events").select(F.when(even, "recent").otherwise("reference").alias("part"), (F.col("value") * F.when(even, 1.2).otherwise(1.0)).alias("value"))
    return monitoring.psi(rows, "value").select(F.round("psi", 6).alias("psi"))


@query(
    "bounded_history",
    "SELECT event_id, place::INT AS place, place <= 200 AS replayed FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 500",
)
def bounded_history(spark, sf_dir):
    """The newest events that a hub keeps, and those that a late client is sent."""
    rows = monitoring.newest(table(spark, sf_dir, "events").select("event_id", "ts"), fixed.HISTORY, *newest_first())
    return rows.select("event_id", "place", (F.col("place") <= fixed.REPLAY).alias("replayed"))


CURRENT = [("precision@5", 0.2188), ("ndcg@5", 0.77), ("ndcg@10", 0.79), ("mrr", 0.1), ("extraction_f1", 0.4891)]
BASELINE = [("precision@5", 0.2188), ("ndcg@5", 0.7984), ("ndcg@10", 0.8), ("mrr", 0.8), ("extraction_f1", 0.5091), ("groundedness", 0.7031)]


def values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in rows)


@query(
    "gate_regressions",
    f"""WITH c(metric, value) AS (SELECT col0, col1::DOUBLE FROM (VALUES {values(CURRENT)})), b(metric, baseline) AS (SELECT col0, col1::DOUBLE FROM (VALUES {values(BASELINE)})),
    t AS (SELECT *, CASE split_part(metric, '@', 1) WHEN 'precision' THEN 0.02 WHEN 'ndcg' THEN 0.02 WHEN 'groundedness' THEN 0.05 WHEN 'extraction_f1' THEN 0.02 END::DOUBLE AS tol FROM b),
    u AS (SELECT count(DISTINCT lang) AS n FROM documents)
    SELECT metric, value, baseline, CASE WHEN value IS NULL THEN 'not measured' ELSE 'drop' END AS reason, n AS n_lang FROM t LEFT JOIN c USING (metric), u WHERE tol IS NOT NULL AND (value IS NULL OR baseline - value > tol)""",
)
def gate_regressions(spark, sf_dir):
    """Fixed metrics through the strict gate, beside the number of languages."""
    c, b = (spark.createDataFrame(rows, "metric string, value double") for rows in (CURRENT, BASELINE))
    n = table(spark, sf_dir, "documents").agg(F.count_distinct("lang").alias("n_lang"))
    return monitoring.regressions(c, b, strict=True).crossJoin(F.broadcast(n))


NOW = [("judge_backend", "gemini"), ("embed_backend", "hash"), ("eval_k", "5"), ("active_version", None)]
WAS = [("judge_backend", "ollama"), ("judge_model", "llama3.2:3b"), ("embed_backend", "hash"), ("eval_k", "5"), ("active_version", "emb_v1"), ("other", "x")]


@query(
    "gate_provenance",
    f"""WITH n(key, now) AS (VALUES {values(NOW)}), w(key, was) AS (VALUES {values(WAS)})
    SELECT key, now, was, (SELECT count(*) FROM benchmark) AS n_items FROM w LEFT JOIN n USING (key) WHERE key <> 'other' AND now IS DISTINCT FROM was""",
)
def gate_provenance(spark, sf_dir):
    now, was = (spark.createDataFrame(rows, "key string, value string") for rows in (NOW, WAS))
    n = table(spark, sf_dir, "benchmark").agg(F.count("*").alias("n_items"))
    return monitoring.provenance_changes(now, was).crossJoin(F.broadcast(n))


@query(
    "model_families",
    """WITH m AS (SELECT event_id, ['gemini', 'ollama', 'openai'][(event_id % 3 + 1)::INT] AS backend, ['gemma2:9b', 'llama3.2:3b', 'Qwen2', 'mixtral:8x7b', 'phi3', NULL][(event_id % 6 + 1)::INT] AS model FROM events),
    h AS (SELECT *, lower(split_part(model, ':', 1)) AS head FROM m)
    SELECT event_id, CASE WHEN backend = 'ollama' AND coalesce(model <> '', false) THEN CASE WHEN contains(head, 'gemma') THEN 'google' WHEN contains(head, 'llama') THEN 'meta' WHEN contains(head, 'qwen') THEN 'qwen' WHEN contains(head, 'mistral') OR contains(head, 'mixtral') THEN 'mistral' ELSE 'local-oss' END
      WHEN backend = 'gemini' THEN 'google' WHEN backend = 'ollama' THEN 'local-oss' ELSE backend END AS family FROM h""",
)
def model_families(spark, sf_dir):
    pick = lambda names: F.element_at(F.array(*[F.lit(n).cast("string") for n in names]), (F.col("event_id") % len(names) + 1).cast("int"))
    e = table(spark, sf_dir, "events")
    return e.select("event_id", monitoring.family(pick(["gemini", "ollama", "openai"]), pick(["gemma2:9b", "llama3.2:3b", "Qwen2", "mixtral:8x7b", "phi3", None])).alias("family"))


@query(
    "prompt_refs",
    """WITH p AS (SELECT 'p' || (item_id // 4) AS name, 'v' || (item_id % 4) AS version, text AS template, item_id % 4 = 0 OR item_id = 5 AS active FROM benchmark)
    SELECT name, version, left(sha256(template), 12) AS content_hash, name || '@' || version || '+' || left(sha256(template), 12) AS ref, sum(active::INT) OVER (PARTITION BY name) = 1 AS single_active FROM p""",
)
def prompt_refs(spark, sf_dir):
    """Benchmark texts as prompt templates, four versions a name."""
    i = F.col("item_id")
    p = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("p"), F.floor(i / 4).cast("string")).alias("name"), F.concat(F.lit("v"), (i % 4).cast("string")).alias("version"), F.col("text").alias("template"), ((i % 4 == 0) | (i == 5)).alias("active"))
    return monitoring.prompt_refs(p).select("name", "version", "content_hash", "ref", "single_active")


@query(
    "index_upsert",
    """SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 'emb_v2' ELSE 'emb_v1' END AS version, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings
    UNION ALL SELECT vec_id + 1000000000, 'emb_v2', label + 100 FROM embeddings WHERE vec_id % 3 = 0""",
)
def index_upsert(spark, sf_dir):
    """Every third point written again, and as many new ones."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit("emb_v1").alias("version"), "label")
    third = e.where("id % 3 = 0").select("id", F.lit("emb_v2").alias("version"), (F.col("label") + 100).alias("label"))
    return monitoring.upserted(e, third.unionByName(third.withColumn("id", F.col("id") + 1_000_000_000)), ["id"])


VECTORS_SQL = "vectors AS (SELECT vec_id AS id, 'emb_v1' AS version FROM embeddings UNION ALL SELECT vec_id, 'emb_v2' FROM embeddings WHERE label < 4)"


def versions(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    v = e.select("id", F.lit("emb_v1").alias("version")).unionByName(e.where("label < 4").select("id", F.lit("emb_v2").alias("version")))
    return e, v


@query("index_coverage", f"WITH {VECTORS_SQL} SELECT version, count(DISTINCT id) AS covered, (SELECT count(*) FROM embeddings) AS total FROM vectors GROUP BY version")
def index_coverage(spark, sf_dir):
    return monitoring.coverage(*versions(spark, sf_dir))


@query("index_backfill", "SELECT vec_id AS id FROM embeddings WHERE label IS NULL OR label >= 4")
def index_backfill(spark, sf_dir):
    """Points that a backfill of the second version has to embed."""
    return monitoring.missing(*versions(spark, sf_dir), "emb_v2").select("id")


@query(
    "cache_misses",
    """WITH t AS (SELECT DISTINCT sha256('BAAI/bge-m3' || chr(0) || text) AS key FROM conversations WHERE text IS NOT NULL), c AS (SELECT sha256('BAAI/bge-m3' || chr(0) || text) AS key FROM conversations WHERE conv_id % 2 = 0)
    SELECT key FROM t ANTI JOIN c USING (key)""",
)
def cache_misses(spark, sf_dir):
    """Texts whose vectors are not cached yet, when even conversations are."""
    key = text.content_hash(F.lit("BAAI/bge-m3"), F.col("text"))
    c = table(spark, sf_dir, "conversations").select("conv_id", key.alias("key")).where("key IS NOT NULL")
    return c.select("key").distinct().join(c.where("conv_id % 2 = 0").select("key"), "key", "left_anti")


@query("label_references", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def label_references(spark, sf_dir):
    """Labelled ids that no document has; whole data sets have none."""
    return table(spark, sf_dir, "labels").select("doc_id").join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_anti")


@query(
    "trace_log",
    f"""SELECT event_id AS trace_id, regexp_replace(regexp_replace('reply to u' || user_id || '@mail.example.de about DE-HUK-2024-' || lpad(event_id::VARCHAR, 6, '0'), '{fixed.REDACTIONS[1][1]}', '[POLICY]', 'g'), '{fixed.REDACTIONS[10][1]}', '[EMAIL]', 'g') AS response FROM events""",
)
def trace_log(spark, sf_dir):
    """What is stored of a reply: redacted first."""
    e = table(spark, sf_dir, "events")
    reply = F.concat(F.lit("reply to u"), F.col("user_id").cast("string"), F.lit("@mail.example.de about DE-HUK-2024-"), F.lpad(F.col("event_id").cast("string"), 6, "0"))
    return e.select(F.col("event_id").alias("trace_id"), rules.redact(reply).alias("response"))


@query("corpus_manifest", "SELECT count(DISTINCT doc_id) AS n_docs, count(*) AS n_rows, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents")
def corpus_manifest(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n_rows"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query(
    "session_utterances",
    """WITH r AS (SELECT user_id, ts, event_id, event_type, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events))
    SELECT user_id, count(*) AS n_pieces, string_agg(event_type, ' ' ORDER BY ts, event_id) AS text FROM r GROUP BY user_id, run""",
)
def session_utterances(spark, sf_dir):
    """Pieces of speech joined until a pause: sessions of a user's events with gaps under half an hour."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n_pieces"), F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("s"))
    return s.select("user_id", "n_pieces", F.array_join(F.transform("s", lambda x: x["event_type"]), " ").alias("text"))
