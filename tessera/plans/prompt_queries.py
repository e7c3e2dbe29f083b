"""Queries of openings, lookups, panels, verdicts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.operators import prompts

from .registry import query, table


@query(
    "opening_lines",
    f"""SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'Hi {{first_name}} {{unknown}}' ELSE replace('{prompts.OPENING.replace(chr(39), chr(39) * 2)}', '{{first_name}}', split_part(c_name, ' ', 1)) END AS line FROM customer""",
)
def opening_lines(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    template = F.when(F.col("c_custkey") % 5 == 0, F.lit("Hi {first_name} {unknown}")).otherwise(F.lit(prompts.OPENING))
    return c.select(F.col("c_custkey").alias("id"), prompts.opening(template, F.col("c_name"), F.lit(None).cast("string")).alias("line"))


@query(
    "lookup_block",
    f"""WITH r AS (SELECT user_id AS call_id, event_id AS seq, event_type AS name, CASE WHEN event_id % 4 = 0 THEN NULL ELSE repeat(event_type || ' ', 60) END AS summary, event_id % 3 = 0 AS stub FROM events),
    n AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY seq DESC) <= 3)
    SELECT call_id, string_agg('  • ' || name || CASE WHEN stub THEN '{prompts.STUB_TAG.replace(chr(39), chr(39) * 2)}' ELSE '' END || E':\\n    "' || left(coalesce(summary, '(no summary)'), 300) || '"', E'\\n' ORDER BY seq) AS block FROM n GROUP BY call_id""",
)
def lookup_block(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    summary = F.when(F.col("event_id") % 4 != 0, F.repeat(F.concat("event_type", F.lit(" ")), F.lit(60)))
    r = e.select(F.col("user_id").alias("call_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("name"), summary.alias("summary"), (F.col("event_id") % 3 == 0).alias("stub"))
    return prompts.last_lookups(r)


@query("last_replies", "SELECT conv_id, turn, CASE WHEN length(trim(text, ' ')) > 280 THEN left(trim(text, ' '), 280) || '…' ELSE trim(text, ' ') END AS reply FROM conversations WHERE role = 'assistant' AND text IS NOT NULL")
def last_replies(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'assistant' AND text IS NOT NULL").select("conv_id", "turn", prompts.last_reply(F.col("text")).alias("reply"))


@query(
    "call_addresses",
    """SELECT user_id, event_id, '+49172' || event_id AS phone, 'host' || user_id || '.example.com' AS host FROM events""",
)
def call_addresses(spark, sf_dir):
    s = lambda c: F.col(c).cast("string")
    room = F.concat(F.lit("call-+49172"), s("event_id"), F.lit("_x"), s("user_id"))
    uri = F.concat(F.lit("sip:u"), s("user_id"), F.lit("@host"), s("user_id"), F.lit(".example.com:5060;transport=tcp"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", prompts.room_phone(room).alias("phone"), prompts.sip_host(uri).alias("host"))


@query("known_callers", "SELECT event_id, coalesce(c_name, 'default') AS profile FROM events LEFT JOIN customer ON c_custkey = user_id * 7")
def known_callers(spark, sf_dir):
    """Callers whose number a customer has, and the default for the others."""
    calls = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") * 7).cast("string").alias("phone"))
    profiles = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("phone"), F.col("c_name").alias("profile"))
    return prompts.known_callers(calls, profiles, "default").select("event_id", "profile")


@query(
    "key_whitelist",
    """WITH j AS (SELECT event_id, unnest([('claim_type', event_type), ('witnesses', ' '), ('delayed_reporting', 'd' || event_id), ('unknown', 'x')]) AS kv FROM events)
    SELECT event_id, kv[1] AS label, kv[2] AS value, CASE WHEN kv[1] = 'delayed_reporting' THEN 'fraud' ELSE 'pillar' END AS kind FROM j WHERE kv[1] <> 'unknown' AND trim(kv[2], ' ') <> ''""",
)
def key_whitelist(spark, sf_dir):
    body = F.to_json(F.struct(F.col("event_type").alias("claim_type"), F.lit(" ").alias("witnesses"), F.concat(F.lit("d"), F.col("event_id").cast("string")).alias("delayed_reporting"), F.lit("x").alias("unknown")))
    rows = table(spark, sf_dir, "events").select("event_id", body.alias("body"))
    return prompts.whitelisted(rows, "body", [p for p, _ in fixed.PILLARS], fixed.FRAUD_SIGNALS).select("event_id", "label", "value", "kind")


@query(
    "profile_panel",
    """SELECT c_custkey, field, value FROM (UNPIVOT (SELECT c_custkey, c_name AS name, c_mktsegment AS segment, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_nationkey::VARCHAR END AS nation FROM customer) ON name, segment, nation INTO NAME field VALUE value)""",
)
def profile_panel(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.when(F.col("c_custkey") % 2 != 0, F.col("c_nationkey").cast("string")).alias("nation"))
    return prompts.panel(c, "c_custkey", ["name", "segment", "nation"])


@query(
    "verdict_rates",
    """WITH v AS (SELECT event_type AS persona, CASE WHEN user_id % 3 = 0 THEN 'human' ELSE 'ai' END AS verdict, CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE (event_id % 10)::VARCHAR END AS score FROM events)
    SELECT persona, count(*) AS n, round(avg((verdict = 'human')::INT), 4) AS human_rate, round(coalesce(avg(try_cast(score AS INT)), 0), 4) AS mean_score FROM v GROUP BY persona""",
)
def verdict_rates(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    v = e.select(F.col("event_type").alias("persona"), F.when(F.col("user_id") % 3 == 0, "human").otherwise("ai").alias("verdict"), F.when(F.col("event_id") % 5 == 0, "n/a").otherwise((F.col("event_id") % 10).cast("string")).alias("score"))
    return prompts.verdict_rates(v, "persona")


@query(
    "label_sets",
    """WITH a AS (SELECT doc_id FROM labels WHERE quality = 1), b AS (SELECT doc_id FROM labels WHERE toxic = 1)
    SELECT doc_id, 'both' AS part FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT doc_id, 'first' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
    UNION ALL SELECT doc_id, 'either' FROM (SELECT * FROM a UNION SELECT * FROM b)""",
)
def label_sets(spark, sf_dir):
    """Intersection, difference and union of two sets of ids."""
    y = table(spark, sf_dir, "labels")
    a, b = y.where("quality = 1").select("doc_id"), y.where("toxic = 1").select("doc_id")
    tag = lambda df, name: df.select("doc_id", F.lit(name).alias("part"))
    return tag(a.intersect(b), "both").unionByName(tag(a.subtract(b), "first")).unionByName(tag(a.union(b).distinct(), "either"))
