"""Queries of extraction and claim state, on turns made from events and on conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import fixed, rules
from tessera.operators import claims

from .registry import query, table

#: What a caller says in a turn, by the remainder of the event's id; {n} is the user's number, {m} the event's.
LINES = [
    "My car crashed on the A{n} near Berlin yesterday at 14:{m}.",
    "The doctor in the hospital treated my whiplash, chest pain. Can you help please?",
    "It is not drivable; the other plate was K-AB {m}, case number 77{m}.",
    "There is loud traffic here, a witness saw it and the police came.",
    "That was 3 weeks ago, it was my fault. Is the damage at the repair shop covered?",
    "Dr. Schmidt did surgery; medication and treatment went on. Are you okay, anyone hurt?",
    "Nothing more to say about it.",
]


def turn_sql() -> str:
    lines = ", ".join("'" + line.replace("'", "''") + "'" for line in LINES)
    return f"""turns AS (
  SELECT user_id AS call_id, event_id AS turn,
         replace(replace([{lines}][(event_id % {len(LINES)} + 1)::INT], '{{n}}', (user_id % 9 + 1)::VARCHAR), '{{m}}', (event_id % 50 + 10)::VARCHAR) AS text
  FROM events)"""


def turns(spark, sf_dir):
    """call_id, turn and text of a caller's lines: a user's events are a call's turns."""
    line = F.element_at(F.array(*map(F.lit, LINES)), (F.col("event_id") % len(LINES) + 1).cast("int"))
    line = F.replace(F.replace(line, F.lit("{n}"), (F.col("user_id") % 9 + 1).cast("string")), F.lit("{m}"), (F.col("event_id") % 50 + 10).cast("string"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("call_id"), F.col("event_id").alias("turn"), line.alias("text"))


def spans_sql() -> str:
    parts = []
    for n, (kind, label, pattern, group, value, score, free) in enumerate(fixed.EXTRACTIONS):
        p = pattern.replace("'", "''")
        found = f"regexp_extract_all(text, '{'(?i)' if free else ''}{p}', {group})"
        own = f"'{value}'" if value else "v"
        parts.append(f"SELECT call_id, turn, '{kind}' AS kind, '{label}' AS label, {own} AS value, {score}::DOUBLE AS score, {n * 1000} + i AS seq FROM (SELECT call_id, turn, unnest({found}) AS v, unnest(range(0, len({found}))) AS i FROM turns)")
    return f"""{turn_sql()}, spans AS ({' UNION ALL '.join(parts)}),
  best AS (SELECT * FROM spans QUALIFY row_number() OVER (PARTITION BY call_id, turn, kind, label ORDER BY score DESC, seq) = 1)"""


SPANS = spans_sql()


@query("extraction_best", f"WITH {SPANS} SELECT call_id, turn, kind, label, value, score FROM best")
def extraction_best(spark, sf_dir):
    return rules.extract(turns(spark, sf_dir), ["call_id", "turn"])


@query("extraction_all_spans", f"WITH {SPANS} SELECT kind, label, value, count(*) AS n, max(score) AS score FROM spans GROUP BY ALL")
def extraction_all_spans(spark, sf_dir):
    s = rules.spans(turns(spark, sf_dir), ["call_id", "turn"])
    return s.groupBy("kind", "label", "value").agg(F.count("*").alias("n"), F.max("score").alias("score"))


@query(
    "extraction_merge",
    f"""WITH {SPANS}, over_ AS (SELECT call_id, turn, 'pillar' AS kind, 'incident_location' AS label, 'model place' AS value, CASE WHEN turn % 2 = 0 THEN 0.75 ELSE 0.9 END::DOUBLE AS score FROM turns),
    both_ AS (SELECT call_id, turn, kind, label, value, score, 0 AS f FROM best UNION ALL SELECT *, 1 FROM over_)
    SELECT call_id, turn, kind, label, value, score FROM both_ QUALIFY row_number() OVER (PARTITION BY call_id, turn, kind, label ORDER BY score DESC, f) = 1""",
)
def extraction_merge(spark, sf_dir):
    t = turns(spark, sf_dir)
    model = t.select("call_id", "turn", F.lit("pillar").alias("kind"), F.lit("incident_location").alias("label"), F.lit("model place").alias("value"), F.when(F.col("turn") % 2 == 0, 0.75).otherwise(0.9).alias("score"))
    return rules.merged(rules.extract(t, ["call_id", "turn"]), model, ["call_id", "turn"])


EMOTION_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p.replace(chr(39), chr(39) * 2)}') THEN '{name}'" for name, p in fixed.EMOTIONS) + " ELSE 'calm' END"


@query("emotion_turns", f"WITH {turn_sql()} SELECT call_id, turn, {EMOTION_SQL} AS emotion FROM turns")
def emotion_turns(spark, sf_dir):
    return turns(spark, sf_dir).select("call_id", "turn", rules.emotion(F.col("text")).alias("emotion"))


@query("emotion_conversations", f"SELECT conv_id, turn, CASE WHEN text IS NULL THEN 'calm' ELSE {EMOTION_SQL} END AS emotion FROM conversations")
def emotion_conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", rules.emotion(F.col("text")).alias("emotion"))


def intents_sql() -> str:
    hits = [f"CASE WHEN regexp_matches(text, '(?i){'|'.join(f'(?:{p})' for p in ps).replace(chr(39), chr(39) * 2)}') THEN '{name}' END" for name, ps in fixed.INTENTS.items()]
    return f"list_sort(list_filter([{', '.join(hits)}], lambda x: x IS NOT NULL))"


@query("intent_questions", f"WITH {turn_sql()} SELECT call_id, turn, array_to_string({intents_sql()}, ',') AS intents FROM turns")
def intent_questions(spark, sf_dir):
    return turns(spark, sf_dir).select("call_id", "turn", F.array_join(rules.intents(F.col("text")), ",").alias("intents"))


def any_sql(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


@query(
    "keyword_triggers",
    f"""WITH {turn_sql()} SELECT call_id, turn,
    array_to_string(list_filter([CASE WHEN {any_sql(fixed.WEATHER_WORDS)} THEN 'weather' END, CASE WHEN {any_sql(fixed.TOWING_WORDS)} THEN 'towing' END, CASE WHEN {any_sql(fixed.COVERAGE_WORDS)} THEN 'coverage' END], lambda x: x IS NOT NULL), ',') AS lookups,
    CASE WHEN {any_sql(fixed.DISTRESS_WORDS)} THEN 'distressed' WHEN {any_sql(fixed.NOISE_WORDS)} THEN 'noisy' ELSE 'calm' END AS mode FROM turns""",
)
def keyword_triggers(spark, sf_dir):
    text = F.col("text")
    return turns(spark, sf_dir).select("call_id", "turn", F.array_join(rules.lookups(text), ",").alias("lookups"), rules.mode(text, F.lit("calm")).alias("mode"))


PLACE_SQL = "CASE " + " ".join(f"WHEN contains(lower(text), '{k}') THEN trim(list_filter(regexp_split_to_array(text, '[,.!?;]'), lambda p: contains(lower(p), '{k}'))[1], ' ')" for k in fixed.PLACES) + " END"


@query("place_phrases", f"WITH {turn_sql()} SELECT call_id, turn, {PLACE_SQL} AS place FROM turns")
def place_phrases(spark, sf_dir):
    return turns(spark, sf_dir).select("call_id", "turn", rules.place(F.col("text")).alias("place"))


def values_sql(pairs: dict) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in pairs.items())


@query(
    "label_aliases",
    f"""WITH names AS (SELECT unnest([{', '.join(repr(x) for x in [*fixed.LABEL_ALIASES, *fixed.HUMAN_LABELS, 'unheard'])}]) AS label),
    a(label, id) AS (VALUES {values_sql(fixed.LABEL_ALIASES)}), h(label, id) AS (VALUES {values_sql(fixed.HUMAN_LABELS)})
    SELECT event_id, label, coalesce(a.id, label) AS canonical, h.id AS known FROM events JOIN names ON true LEFT JOIN a USING (label) LEFT JOIN h USING (label)""",
)
def label_aliases(spark, sf_dir):
    names = [*fixed.LABEL_ALIASES, *fixed.HUMAN_LABELS, "unheard"]
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(F.array(*map(F.lit, names))).alias("label"))
    return rows.select("event_id", "label", claims.aliased(F.col("label")).alias("canonical"), claims.literal_map(fixed.HUMAN_LABELS)[F.col("label")].alias("known"))


FILLED_SQL = f"""{SPANS}, filled AS (
  SELECT call_id, label, value, score, turn FROM best WHERE kind = 'pillar' QUALIFY row_number() OVER (PARTITION BY call_id, label ORDER BY score DESC, turn) = 1)"""


def filled(spark, sf_dir):
    return claims.filled(rules.extract(turns(spark, sf_dir), ["call_id", "turn"]))


@query("claim_pillars", f"WITH {FILLED_SQL} SELECT * FROM filled")
def claim_pillars(spark, sf_dir):
    return filled(spark, sf_dir)


FLAGS_SQL = f"""flags AS (
  SELECT user_id AS call_id, event_id AS turn, [{', '.join(repr(x) for x in fixed.FRAUD_SIGNALS)}][(event_id % 5 + 1)::INT] AS signal, event_type AS evidence,
         ['low', 'medium', 'high', 'odd'][(user_id % 4 + 1)::INT] AS severity FROM events WHERE value IS NOT NULL),
  last AS (SELECT * FROM flags QUALIFY row_number() OVER (PARTITION BY call_id, signal ORDER BY turn DESC) = 1)"""


def flags(spark, sf_dir):
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    e = table(spark, sf_dir, "events").where("value IS NOT NULL")
    return e.select(
        F.col("user_id").alias("call_id"), F.col("event_id").alias("turn"), pick(fixed.FRAUD_SIGNALS, F.col("event_id") % 5).alias("signal"),
        F.col("event_type").alias("evidence"), pick(["low", "medium", "high", "odd"], F.col("user_id") % 4).alias("severity"),
    )


@query("fraud_flags", f"WITH {FLAGS_SQL} SELECT call_id, signal, evidence, severity, turn FROM last")
def fraud_flags(spark, sf_dir):
    return claims.flagged(flags(spark, sf_dir))


@query(
    "fraud_risk",
    f"""WITH {FLAGS_SQL}, s AS (SELECT call_id, least(10, sum(CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 4 ELSE 1 END))::BIGINT AS score,
      least(10.0::DOUBLE, sum(CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2.5 WHEN 'high' THEN 5 ELSE 1 END)::DOUBLE) AS gauge FROM last GROUP BY call_id)
    SELECT call_id, score, gauge, CASE WHEN gauge >= 7 THEN 'high' WHEN gauge >= 4 THEN 'moderate' ELSE 'low' END AS band FROM s""",
)
def fraud_risk(spark, sf_dir):
    return claims.risk(claims.flagged(flags(spark, sf_dir)))


def list_sql(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


@query(
    "claim_progress",
    f"""WITH {FILLED_SQL}, o AS (SELECT call_id, max(value) FILTER (label = 'claim_type') AS v, list(label) AS labels FROM filled GROUP BY call_id),
    k AS (SELECT *, CASE WHEN regexp_matches(lower(coalesce(v, '')), 'health|medical|gesundheit') THEN 'health' WHEN regexp_matches(lower(coalesce(v, '')), 'auto|car|vehicle|kfz') THEN 'auto' END AS claim_type FROM o),
    a AS (SELECT *, {list_sql(fixed.COMMON_PILLARS)} || CASE claim_type WHEN 'health' THEN {list_sql(fixed.HEALTH_PILLARS)} WHEN 'auto' THEN {list_sql(fixed.AUTO_PILLARS)} ELSE [] END AS every FROM k)
    SELECT call_id, claim_type, len(list_intersect(every, labels))::INT AS n_filled, len(every)::INT AS n_applicable, round(len(list_intersect(every, labels)) / len(every)::DOUBLE, 4) AS share FROM a""",
)
def claim_progress(spark, sf_dir):
    return claims.progress(filled(spark, sf_dir))


@query(
    "claim_targets",
    f"""WITH {FILLED_SQL}, calls AS (SELECT DISTINCT call_id FROM turns), have AS (SELECT call_id, list(label) AS f FROM filled GROUP BY call_id),
    said AS (SELECT call_id, list(DISTINCT i) AS a FROM (SELECT call_id, unnest({intents_sql()}) AS i FROM turns) GROUP BY call_id),
    r AS (SELECT call_id, coalesce(f, []) AS f, coalesce(a, []) AS a FROM calls LEFT JOIN have USING (call_id) LEFT JOIN said USING (call_id)),
    l AS (SELECT *, list_filter({list_sql(p for p, _ in fixed.PILLARS)}, lambda p: NOT list_contains(f, p)) AS left_ FROM r),
    b AS (SELECT *, list_filter(left_, lambda p: NOT list_contains(a, p)) AS open, list_filter(left_, lambda p: list_contains(a, p)) AS parked FROM l)
    SELECT call_id, CASE WHEN len(f) = 0 THEN 'greeting' WHEN NOT list_contains(f, 'injuries_or_symptoms') AND NOT list_contains(f, 'claim_type') THEN 'safety_or_triage' WHEN len(f) < 7 THEN 'detail' ELSE 'wrap_up' END AS phase,
      array_to_string(open, ',') AS open, array_to_string(parked, ',') AS parked,
      CASE WHEN len(open) + len(parked) = 0 THEN 'all captured' ELSE array_to_string(open[1:4], ', ') || CASE WHEN len(open) > 4 THEN ' and ' || (len(open) - 4) || ' more' ELSE '' END END AS text FROM b""",
)
def claim_targets(spark, sf_dir):
    t = turns(spark, sf_dir)
    asked = t.select("call_id", F.explode(rules.intents(F.col("text"))).alias("label"))
    out = claims.targets(t.select("call_id").distinct(), filled(spark, sf_dir), asked)
    return out.select("call_id", "phase", F.array_join("open", ",").alias("open"), F.array_join("parked", ",").alias("parked"), "text")


@query(
    "asked_so_far",
    f"""WITH {turn_sql()}, a AS (SELECT call_id, turn, {intents_sql()} AS asked FROM turns)
    SELECT call_id, turn, array_to_string(list_sort(list_distinct(flatten(list(asked) OVER (PARTITION BY call_id ORDER BY turn ROWS UNBOUNDED PRECEDING)))), ',') AS asked_so_far FROM a""",
)
def asked_so_far(spark, sf_dir):
    t = turns(spark, sf_dir).select("call_id", "turn", rules.intents(F.col("text")).alias("asked"))
    return claims.asked_so_far(t).select("call_id", "turn", F.array_join("asked_so_far", ",").alias("asked_so_far"))


def conversation(spark, sf_dir):
    return table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "call_id")


@query(
    "speaker_runs",
    """WITH r AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (
        SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)))
    SELECT conv_id AS call_id, run::BIGINT AS run, role, string_agg(text, ' ' ORDER BY turn) AS text, max(turn) AS turn FROM r GROUP BY conv_id, run, role""",
)
def speaker_runs(spark, sf_dir):
    return claims.speaker_runs(conversation(spark, sf_dir))


@query(
    "user_turns",
    """WITH r AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS n,
        last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS line FROM conversations)
    SELECT conv_id AS call_id, turn, n::BIGINT AS user_turn, left(line, 280) AS last_agent, n >= 6 AS wrap_up FROM r WHERE role = 'user'""",
)
def user_turns(spark, sf_dir):
    return claims.user_turns(conversation(spark, sf_dir))


@query(
    "rolling_chunk",
    r"""WITH s AS (SELECT conv_id, list_filter(regexp_split_to_array(string_agg(text, ' ' ORDER BY turn), '\s+'), lambda w: w <> '') AS w FROM conversations GROUP BY conv_id)
    SELECT conv_id AS call_id, array_to_string(CASE WHEN len(w) > 40 THEN w[len(w) - 39 :] ELSE w END, ' ') AS chunk, len(w)::INT AS n_words FROM s""",
)
def rolling_chunk(spark, sf_dir):
    return claims.rolling_chunk(conversation(spark, sf_dir))


@query(
    "transcript_format",
    """SELECT conv_id AS call_id, string_agg('[' || lpad(turn::VARCHAR, 2, '0') || '] ' || upper(role) || ': ' || coalesce(text, ''), E'\n' ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id""",
)
def transcript_format(spark, sf_dir):
    line = F.concat(F.lit("["), F.lpad(F.col("turn").cast("string"), 2, "0"), F.lit("] "), F.upper("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    rows = conversation(spark, sf_dir).groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("s"))
    return rows.select("call_id", F.array_join(F.transform("s", lambda x: x["line"]), "\n").alias("transcript"))


BUS_SQL = """bus AS (SELECT user_id AS call_id, event_id AS seq,
    ['call_start', 'entity', 'fraud_signal', 'emotional_state', 'tool_call', 'tool_result', 'transcript', 'call_end', 'noise'][(event_id * 7 % 9 + 1)::INT] AS type,
    event_type AS name, (event_id % 13)::VARCHAR AS value FROM events),
  s AS (SELECT *, max(CASE WHEN type = 'call_start' THEN seq END) OVER (PARTITION BY call_id) AS start FROM bus),
  live AS (SELECT * FROM s WHERE start IS NULL OR seq >= start)"""


@query(
    "event_reducer",
    f"""WITH {BUS_SQL},
    base AS (SELECT call_id, coalesce(arg_max(value, CASE WHEN type = 'emotional_state' THEN seq END), 'calm') AS mode,
        coalesce(arg_max(type, CASE WHEN type IN ('call_start', 'call_end') THEN seq END) = 'call_start', false) AS active, count(*) FILTER (type = 'transcript') AS n_lines FROM live GROUP BY call_id),
    up AS (SELECT call_id, type, name, arg_max(value, seq) AS value FROM live WHERE type IN ('entity', 'fraud_signal') GROUP BY ALL),
    p AS (SELECT call_id, string_agg(name || '=' || value, ',' ORDER BY name) FILTER (type = 'entity') AS pillars, string_agg(name || '=' || value, ',' ORDER BY name) FILTER (type = 'fraud_signal') AS fraud FROM up GROUP BY call_id),
    t AS (SELECT call_id, string_agg(name, ',' ORDER BY seq DESC) AS tools FROM (SELECT * FROM live WHERE type IN ('tool_call', 'tool_result') QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY seq DESC) <= 10) GROUP BY call_id)
    SELECT call_id, mode, active, n_lines, tools, pillars, fraud FROM base LEFT JOIN p USING (call_id) LEFT JOIN t USING (call_id)""",
)
def event_reducer(spark, sf_dir):
    out = claims.reduced(bus(spark, sf_dir))
    flat = lambda c: F.array_join(F.transform(F.map_entries(c), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias(c)
    return out.select("call_id", "mode", "active", "n_lines", F.array_join("tools", ",").alias("tools"), flat("pillars"), flat("fraud"))


BUS_TYPES = ["call_start", "entity", "fraud_signal", "emotional_state", "tool_call", "tool_result", "transcript", "call_end", "noise"]


def bus(spark, sf_dir):
    """Dashboard events: call_id, seq, type, name and value."""
    kind = F.element_at(F.array(*map(F.lit, BUS_TYPES)), (F.col("event_id") * 7 % 9 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("call_id"), F.col("event_id").alias("seq"), kind.alias("type"), F.col("event_type").alias("name"), (F.col("event_id") % 13).cast("string").alias("value"))


@query(
    "label_f1",
    f"""WITH {FILLED_SQL}, p AS (SELECT call_id, list(label) AS p FROM filled GROUP BY call_id),
    g AS (SELECT call_id, p, CASE call_id % 3 WHEN 0 THEN ['claim_type', 'witnesses', 'road_type'] WHEN 1 THEN ['incident_location'] ELSE [] END AS g FROM p),
    n AS (SELECT call_id, len(g) AS ng, len(list_intersect(p, g)) AS tp, len(p) AS np FROM g)
    SELECT call_id, round(CASE WHEN ng = 0 THEN 1 WHEN tp = 0 THEN 0 ELSE 2 * (tp / np::DOUBLE) * (tp / ng::DOUBLE) / (tp / np::DOUBLE + tp / ng::DOUBLE) END::DOUBLE, 6) AS f1 FROM n""",
)
def label_f1(spark, sf_dir):
    p = filled(spark, sf_dir).groupBy("call_id").agg(F.collect_set("label").alias("predicted"))
    array = lambda *names: F.array(*map(F.lit, names)).cast("array<string>")
    gold = F.when(F.col("call_id") % 3 == 0, array("claim_type", "witnesses", "road_type")).when(F.col("call_id") % 3 == 1, array("incident_location")).otherwise(array())
    p = p.withColumn("gold", gold)
    return p.select("call_id", F.round(claims.label_f1(p), 6).alias("f1"))
