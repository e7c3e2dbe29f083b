"""Queries of evaluation means, label coverage, settings, lookups, traces and redacted rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.operators import evaluation

from .registry import query, table


@query(
    "final_transcripts",
    r"SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM conversations WHERE turn % 3 <> 1 AND regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''",
)
def final_transcripts(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("is_final", F.col("turn") % 3 != 1)
    return evaluation.final_turns(turns).select("conv_id", "turn", "text")


@query(
    "judged_means",
    """SELECT 'groundedness' AS metric, round(sum((event_id * 37 % 101) / 100.0::DOUBLE) / count(*), 4) AS mean FROM events
    UNION ALL SELECT 'faithfulness', round(sum((event_id * 53 % 101) / 100.0::DOUBLE) / count(*), 4) FROM events""",
)
def judged_means(spark, sf_dir):
    """Means over judges' replies, made from the ids, as they are read back from text around an object."""
    reply = F.format_string('Sure:\n```json\n{"groundedness": %s, "faithfulness": %s}\n```', (F.col("event_id") * 37 % 101 / 100).cast("string"), (F.col("event_id") * 53 % 101 / 100).cast("string"))
    scores = table(spark, sf_dir, "events").select(evaluation.judge_scores(reply).alias("s")).select("s.*")
    return evaluation.score_means(scores, ["groundedness", "faithfulness"])


@query(
    "expected_label_coverage",
    """WITH want AS (SELECT DISTINCT o_custkey AS customer, o_orderpriority AS label FROM orders),
    got AS (SELECT DISTINCT o_custkey AS customer, o_orderpriority AS label FROM orders WHERE o_orderstatus = 'F')
    SELECT w.customer, count(*) AS expected, count(g.label) AS found, array_to_string(list_sort(list(w.label) FILTER (g.label IS NULL)), '|') AS missing, round(100 * count(g.label) / count(*)::DOUBLE, 4) AS pct
    FROM want w LEFT JOIN got g USING (customer, label) GROUP BY w.customer""",
)
def expected_label_coverage(spark, sf_dir):
    """Priorities of a customer's orders that finished orders have as well."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("label"), "o_orderstatus")
    per = evaluation.label_coverage(o, o.where("o_orderstatus = 'F'"), "customer")
    return per.withColumn("missing", F.when(F.size("missing") > 0, F.array_join("missing", "|")))


@query("latency_means", "SELECT event_type AS kind, count(*) AS runs, round(avg(value), 1) AS mean_ms FROM events GROUP BY event_type")
def latency_means(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("value").alias("latency_ms"))
    return evaluation.latency_means(e, "kind")


@query(
    "rubric_means",
    """WITH t AS (SELECT event_id % 5 + 1 AS naturalness, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 7 END AS completeness, event_id % 11 = 3 AS failed FROM events)
    SELECT 'naturalness' AS criterion, count(naturalness) AS n, round(avg(naturalness), 2) AS mean FROM t WHERE NOT failed
    UNION ALL SELECT 'completeness', count(completeness), round(avg(completeness), 2) FROM t WHERE NOT failed""",
)
def rubric_means(spark, sf_dir):
    i = F.col("event_id")
    t = table(spark, sf_dir, "events").select(
        (i % 5 + 1).alias("naturalness"), F.when(i % 4 == 0, F.lit("n/a")).otherwise((i % 7).cast("string")).alias("completeness"), F.lit("4.5").alias("no_repetition"), F.when(i % 11 == 3, "no JSON").alias("error")
    )
    return evaluation.rubric_means(t, ["naturalness", "completeness", "no_repetition"])


@query("golden_first", f"SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT {fixed.TOP_FINAL}")
def golden_first(spark, sf_dir):
    """The first rows of a golden set, as many as a limit of 0 stands for."""
    return evaluation.first_of(table(spark, sf_dir, "benchmark").select("item_id", "text"), evaluation.limit_or(0, fixed.TOP_FINAL), "item_id")


@query("source_vocabularies", "SELECT lang, array_to_string(list_sort(list(DISTINCT source) FILTER (source IS NOT NULL)), '|') AS labels FROM documents GROUP BY lang")
def source_vocabularies(spark, sf_dir):
    v = evaluation.vocabulary(table(spark, sf_dir, "documents"), "source", "lang")
    return v.select("lang", F.when(F.size("labels") > 0, F.array_join("labels", "|")).alias("labels"))


@query(
    "model_rotation",
    """WITH r AS (SELECT event_id, list_filter([event_type, 'm' || (user_id % 3), '', 'm' || (event_id % 3), event_type], lambda m: m IS NOT NULL AND m <> '') AS m FROM events)
    SELECT event_id, array_to_string(list_filter(m, lambda x, i: list_position(m, x) = i), '|') AS models FROM r""",
)
def model_rotation(spark, sf_dir):
    e, m = table(spark, sf_dir, "events"), lambda c: F.concat(F.lit("m"), (F.col(c) % 3).cast("string"))
    return e.select("event_id", F.array_join(evaluation.rotation(F.col("event_type"), m("user_id"), F.lit(""), m("event_id"), F.col("event_type")), "|").alias("models"))


@query(
    "scenario_settings",
    """WITH s AS (SELECT o_orderkey AS scenario, o_custkey AS crm_profile, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS domain FROM orders),
    d AS (SELECT DISTINCT o_orderpriority AS domain, length(o_orderpriority) AS size FROM orders UNION ALL SELECT 'insurance_fnol', 0)
    SELECT scenario, crm_profile, c_name AS name, coalesce(s.domain, 'insurance_fnol') AS domain, size::INT AS size
    FROM s JOIN customer ON c_custkey = crm_profile JOIN d ON d.domain = coalesce(s.domain, 'insurance_fnol')""",
)
def scenario_settings(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    scenarios = o.select(F.col("o_orderkey").alias("scenario"), F.col("o_custkey").alias("crm_profile"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("domain"))
    profiles = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("crm_profile"), F.col("c_name").alias("name"))
    domains = o.select(F.col("o_orderpriority").alias("domain")).distinct().withColumn("size", F.length("domain"))
    domains = domains.unionByName(spark.createDataFrame([(evaluation.DEFAULT_DOMAIN, 0)], "domain string, size int"))
    return evaluation.settings(scenarios, profiles, domains).select("scenario", "crm_profile", "name", "domain", "size")


@query("citations", "SELECT doc_id, '[' || coalesce(source, '?') || '] ' || coalesce(text, '') AS cited FROM documents")
def citations(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", evaluation.cite(F.coalesce("source", F.lit("?")), F.coalesce("text", F.lit(""))).alias("cited"))


@query(
    "judge_conflicts",
    """WITH m AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'gemini' ELSE 'openai' END AS g, CASE WHEN event_id % 3 = 0 THEN 'gemini' ELSE 'anthropic' END AS j FROM events)
    SELECT event_id, CASE WHEN g = 'gemini' AND j = 'gemini' THEN 'judge and generator are both of family google (generator gemini, judge gemini): groundedness is biased upward' END AS conflict FROM m""",
)
def judge_conflicts(spark, sf_dir):
    i, none = F.col("event_id"), F.lit(None).cast("string")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(i % 2 == 0, "gemini").otherwise("openai").alias("gen_backend"), none.alias("gen_model"), F.when(i % 3 == 0, "gemini").otherwise("anthropic").alias("judge_backend"), none.alias("judge_model"))
    return evaluation.scored_families(rows).select("event_id", "conflict")


@query(
    "lookups",
    """SELECT event_id AS query_id, CASE WHEN event_id % 3 = 0 THEN event_type || ' found' ELSE '[stub] weather: ' || event_type END AS summary, event_id % 3 <> 0 AS stub, CASE WHEN event_id % 3 = 1 THEN 'timed out' END AS error FROM events""",
)
def lookups(spark, sf_dir):
    """Lookups of which one in three answers, one fails and one gives nothing."""
    asked = table(spark, sf_dir, "events").select(F.col("event_id").alias("query_id"), F.lit("weather").alias("name"), F.col("event_type").alias("query"))

    def lookup(batch):
        third = F.col("query_id") % 3
        return batch.where(third != 2).select("query_id", F.when(third == 0, F.concat("query", F.lit(" found"))).alias("summary"), F.when(third == 1, "timed out").alias("error"))

    return evaluation.looked_up(asked, lookup)


@query(
    "trace_store",
    """WITH t AS (SELECT event_id // 3 AS trace_id, event_id, ts, ts + to_milliseconds(event_id % 500) AS ended FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY event_id DESC) AS place FROM t)
    SELECT trace_id, event_id, (event_id % 500)::DOUBLE AS latency_ms FROM n WHERE place = 1""",
)
def trace_store(spark, sf_dir):
    """Traces that are written again under their id, with their latency."""
    e = table(spark, sf_dir, "events")
    t = e.select(F.expr("event_id div 3").alias("trace_id"), "event_id", F.col("ts").cast("timestamp").alias("started"))
    t = t.withColumn("ended", F.timestamp_micros(F.unix_micros("started") + F.col("event_id") % 500 * 1000))
    return evaluation.newest_traces(evaluation.trace_latency(t), "trace_id", F.desc("event_id")).select("trace_id", "event_id", "latency_ms")
