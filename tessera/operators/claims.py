"""Claim state folded from conversation turns, in batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.functions.text import words as text_words


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def aliased(label: Column, aliases: dict = fixed.LABEL_ALIASES) -> Column:
    """The canonical name of a label; the label itself if it has none."""
    return F.coalesce(F.get(F.array(literal_map(aliases)), F.lit(0))[label], label)


def known(rows: DataFrame, label: str = "label", names: dict = fixed.HUMAN_LABELS) -> DataFrame:
    """rows with human labels turned into ids; rows of unknown labels go."""
    return rows.withColumn(label, literal_map(names)[F.col(label)]).where(F.col(label).isNotNull())


def filled(spans: DataFrame, key: str = "call_id") -> DataFrame:
    """key, label, value, score and turn of each filled pillar.

    A later value replaces an earlier one only with a strictly higher score, so the highest score's first turn stands.
    """
    first = F.min_by(F.struct("value", "score", "turn"), F.struct(-F.col("score"), F.col("turn")))  # partial sums: a call may have most of all rows
    return spans.where("kind = 'pillar'").groupBy(key, "label").agg(first.alias("_b")).select(key, "label", "_b.*")


def flagged(signals: DataFrame, key: str = "call_id") -> DataFrame:
    """key, signal, evidence, severity and turn: the last flag of each signal."""
    last = F.max_by(F.struct("evidence", "severity", "turn"), F.col("turn"))
    return signals.groupBy(key, "signal").agg(last.alias("_l")).select(key, "signal", "_l.*")


def risk(flags: DataFrame, key: str = "call_id") -> DataFrame:
    """key, score (0 to 10), gauge and band of the flagged signals."""
    score = F.sum(F.coalesce(literal_map(fixed.RISK_WEIGHTS)[F.col("severity")], F.lit(1)))
    gauge = F.least(F.lit(float(fixed.RISK_CAP)), F.sum(F.coalesce(literal_map(fixed.GAUGE_WEIGHTS)[F.col("severity")], F.lit(1.0))))
    out = flags.groupBy(key).agg(F.least(F.lit(fixed.RISK_CAP).cast("long"), score).alias("score"), gauge.alias("gauge"))
    return out.withColumn("band", F.when(F.col("gauge") >= fixed.HIGH_RISK, "high").when(F.col("gauge") >= fixed.MODERATE_RISK, "moderate").otherwise("low"))


def claim_type(value: Column) -> Column:
    """health or auto by the words in a value; null if unknown."""
    low = F.lower(F.coalesce(value, F.lit("")))
    holds = lambda words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    return F.when(holds(fixed.HEALTH_WORDS), "health").when(holds(fixed.AUTO_WORDS), "auto")


def progress(pillars: DataFrame, key: str = "call_id") -> DataFrame:
    """key, claim_type, n_filled, n_applicable and share of the pillars that apply to the claim's type."""
    own = pillars.groupBy(key).agg(F.max(F.when(F.col("label") == "claim_type", F.col("value"))).alias("_value"), F.collect_set("label").alias("_labels"))
    extra = {"health": fixed.HEALTH_PILLARS, "auto": fixed.AUTO_PILLARS}
    kind = claim_type(F.col("_value"))
    array = lambda names: F.array(*map(F.lit, names))
    more = F.when(kind == "health", array(extra["health"])).when(kind == "auto", array(extra["auto"])).otherwise(F.array().cast("array<string>"))
    own = own.withColumn("_all", F.concat(array(fixed.COMMON_PILLARS), more)).withColumn("claim_type", kind)
    n, of = F.size(F.array_intersect("_all", "_labels")), F.size("_all")
    return own.select(key, "claim_type", n.alias("n_filled"), of.alias("n_applicable"), F.round(n / of, 4).alias("share"))


def phase(labels: Column) -> Column:
    """Conversation phase by the filled labels."""
    either = F.array_contains(labels, "injuries_or_symptoms") | F.array_contains(labels, "claim_type")
    return F.when(F.size(labels) == 0, "greeting").when(~either, "safety_or_triage").when(F.size(labels) < fixed.DETAIL_PILLARS, "detail").otherwise("wrap_up")


def targets(calls: DataFrame, pillars: DataFrame, asked: DataFrame, key: str = "call_id", wanted: list = fixed.PILLARS) -> DataFrame:
    """key, phase, open, parked and text of what is left to ask: neither filled nor asked, and asked but not filled.

    calls: key; pillars: key, label; asked: key, label. The text names the first few open targets and
    counts the others.
    """
    have = pillars.groupBy(key).agg(F.collect_set("label").alias("_filled"))
    said = asked.groupBy(key).agg(F.collect_set("label").alias("_asked"))
    rows = calls.join(have, key, "left").join(said, key, "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumn("_filled", F.coalesce("_filled", none)).withColumn("_asked", F.coalesce("_asked", none))
    left = F.array_except(F.array(*[F.lit(p) for p, _ in wanted]), F.col("_filled"))
    rows = rows.withColumn("open", F.array_except(left, "_asked")).withColumn("parked", F.array_intersect(left, F.col("_asked")))
    named = F.array_join(F.slice("open", 1, fixed.OPEN_NAMED), ", ")
    more = F.size("open") - fixed.OPEN_NAMED
    text = F.when(F.size("open") + F.size("parked") == 0, "all captured").otherwise(F.concat(named, F.when(more > 0, F.format_string(" and %d more", more)).otherwise("")))
    return rows.select(key, phase(F.col("_filled")).alias("phase"), "open", "parked", text.alias("text"))


def asked_so_far(turns: DataFrame, key: str = "call_id", labels: list[str] | None = None) -> DataFrame:
    """turns (key, turn, asked array) with the sorted set of all that was asked up to each turn.

    One running flag a label, so that a long call costs its length and not its square.
    """
    upto = W.partitionBy(key).orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    flags = [F.when(F.max(F.array_contains("asked", x)).over(upto), F.lit(x)) for x in sorted(labels or fixed.INTENTS)]
    return turns.withColumn("asked_so_far", F.array_compact(F.array(*flags)))


def speaker_runs(turns: DataFrame, key: str = "call_id", speaker: str = "role") -> DataFrame:
    """key, run, speaker, text and turn: neighbouring turns of one speaker as one, with the last turn's number."""
    order = W.partitionBy(key).orderBy("turn")
    new = F.when(F.col(speaker).eqNullSafe(F.lag(speaker).over(order)) & (F.row_number().over(order) > 1), 0).otherwise(1)
    rows = turns.withColumn("_new", new).withColumn("run", F.sum("_new").over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy(key, "run", speaker).agg(text.alias("text"), F.max("turn").alias("turn"))


def user_turns(turns: DataFrame, key: str = "call_id", speaker: str = "role", user: str = "user", agent: str = "assistant", wrap: int = fixed.WRAP_UP_TURN) -> DataFrame:
    """The user's turns with their number, the agent's line before, cut, and whether to wrap up."""
    before = W.partitionBy(key).orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    line = F.last(F.when(F.col(speaker) == agent, F.col("text")), ignorenulls=True).over(before)
    count = F.sum(F.when(F.col(speaker) == user, 1).otherwise(0)).over(W.partitionBy(key).orderBy("turn").rowsBetween(W.unboundedPreceding, 0))
    rows = turns.withColumn("last_agent", F.substring(line, 1, fixed.REPLY_CHARS)).withColumn("user_turn", count)
    return rows.where(F.col(speaker) == user).select(key, "turn", "user_turn", "last_agent", (F.col("user_turn") >= wrap).alias("wrap_up"))


def rolling_chunk(turns: DataFrame, key: str = "call_id", words: int = fixed.CHUNK_WORDS) -> DataFrame:
    """key, the last 2 * words words of all that was said, in turn order, and the number of all words.

    Only the turns that reach into the chunk are brought together.
    """
    later = W.partitionBy(key).orderBy(F.desc("turn")).rowsBetween(W.unboundedPreceding, -1)
    rows = turns.select(key, "turn", text_words(F.col("text")).alias("_w")).withColumn("_later", F.coalesce(F.sum(F.size("_w")).over(later), F.lit(0)))
    kept = F.when(F.col("_later") < 2 * words, F.struct("turn", "_w"))
    said = rows.groupBy(key).agg(F.array_sort(F.collect_list(kept)).alias("_s"), F.sum(F.size("_w")).cast("int").alias("n_words"))
    every = F.flatten(F.transform("_s", lambda x: x["_w"]))
    tail = F.when(F.size(every) > 2 * words, F.slice(every, -2 * words, 2 * words)).otherwise(every)
    return said.select(key, F.array_join(tail, " ").alias("chunk"), "n_words")


def reduced(events: DataFrame, key: str = "call_id") -> DataFrame:
    """key, mode, active, n_lines, tools (newest first), pillars and fraud of each call's events since its last start.

    events: key, seq, type, name, value. Entities and signals upsert by name, modes replace one another, an end stops the
    call; types that are null or unknown change nothing.
    """
    order = W.partitionBy(key).orderBy("seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    live = events.withColumn("_start", F.max(F.when(F.col("type") == "call_start", F.col("seq"))).over(order))
    live = live.where(F.col("_start").isNull() | (F.col("seq") >= F.col("_start")))
    kind = lambda *names: F.col("type").isin(*names)
    latest = lambda name: live.where(kind(name)).groupBy(key, "name").agg(F.max_by("value", "seq").alias("value"))
    mapped = lambda name, out: latest(name).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias(out))
    tools = live.where(kind("tool_call", "tool_result")).withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc("seq")))).where(F.col("_n") <= fixed.TOOL_FEED)
    tools = tools.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "name"))), lambda x: x["name"]).alias("tools"))
    base = live.groupBy(key).agg(
        F.coalesce(F.max_by("value", F.when(kind("emotional_state"), F.col("seq"))), F.lit("calm")).alias("mode"),
        F.coalesce(F.max_by(F.col("type"), F.when(kind("call_start", "call_end"), F.col("seq"))) == "call_start", F.lit(False)).alias("active"),
        F.count(F.when(kind("transcript"), 1)).alias("n_lines"),
    )
    return base.join(tools, key, "left").join(mapped("entity", "pillars"), key, "left").join(mapped("fraud_signal", "fraud"), key, "left")


def label_f1(rows: DataFrame, predicted: str = "predicted", gold: str = "gold") -> Column:
    """F1 of two arrays of labels by presence; 1 without gold, 0 without a hit."""
    tp = F.size(F.array_intersect(predicted, gold))
    fp, fn = F.size(F.array_except(predicted, gold)), F.size(F.array_except(gold, predicted))
    p, r = tp / (tp + fp), tp / (tp + fn)
    return F.when(F.size(gold) == 0, 1.0).when(tp == 0, 0.0).otherwise(2 * p * r / (p + r))
