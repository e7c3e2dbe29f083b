"""Means of judged answers, label coverage, judges, lookups with stand-ins and small rules of evaluation runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from tessera.functions import rules

#: Fixed value: the domain of a scenario that names none.
DEFAULT_DOMAIN = "insurance_fnol"


class JudgeUnavailable(RuntimeError):
    """No judge is at hand, or its reply can't be read: a metric is then absent, never neutral."""


def judged(answers: DataFrame, judge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """answers with the scores of a judge, a function of the whole batch; without a judge an error."""
    if judge is None:
        raise JudgeUnavailable("no judge is set")
    return judge(answers)


def judge_scores(raw: Column) -> Column:
    """groundedness, faithfulness, answer_correctness and rationale out of a judge's reply; null if it holds no object that can be read.

    Missing scores are 0, a missing correctness null, a missing rationale empty.
    """
    kind = "struct<groundedness:double,faithfulness:double,answer_correctness:double,rationale:string>"
    got = F.from_json(json_between(raw), kind)
    readable = F.try_parse_json(json_between(raw)).isNotNull()
    one = F.struct(
        F.coalesce(got["groundedness"], F.lit(0.0)).alias("groundedness"), F.coalesce(got["faithfulness"], F.lit(0.0)).alias("faithfulness"),
        got["answer_correctness"].alias("answer_correctness"), F.coalesce(got["rationale"], F.lit("")).alias("rationale"),
    )
    return F.when(readable, one)


def json_between(raw: Column) -> Column:
    """What stands from the first { to the last } of a reply, code fences or other words around it or not; null without both."""
    return F.nullif(F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)\{.*\}", 0), F.lit(""))


def score_means(scores: DataFrame, names: list[str], places: int = 4) -> DataFrame:
    """metric and mean of each column, rounded; 0 of no rows."""
    means = scores.agg(*(F.round(F.coalesce(F.sum(c) / F.count("*"), F.lit(0.0)), places).alias(c) for c in names))
    return means.unpivot([], names, "metric", "mean")


def label_coverage(expected: DataFrame, found: DataFrame, by: str) -> DataFrame:
    """by, expected, found, missing and pct of each case: how many of its expected labels are found. Labels count once a case."""
    want = expected.select(by, "label").distinct()
    hit = want.join(found.select(by, "label", F.lit(1).alias("hit")).distinct(), [by, "label"], "left")
    per = hit.groupBy(by).agg(F.count("*").alias("expected"), F.count("hit").alias("found"), F.array_sort(F.collect_list(F.when(F.col("hit").isNull(), F.col("label")))).alias("missing"))
    return per.withColumn("pct", F.round(100 * F.col("found") / F.col("expected"), 4))


def latency_means(runs: DataFrame, by: str, ms: str = "latency_ms") -> DataFrame:
    """by and the mean latency to one place."""
    return runs.groupBy(by).agg(F.count("*").alias("runs"), F.round(F.avg(ms), 1).alias("mean_ms"))


def rubric_means(transcripts: DataFrame, names: list[str]) -> DataFrame:
    """criterion, n and mean over transcripts without an error; scores that are no integers are left out, and criteria without any."""
    rows = transcripts.where("error IS NULL").select(*(F.col(c).cast("string").alias(c) for c in names)).unpivot([], names, "criterion", "score")
    whole = rows.where(F.rlike("score", F.lit(r"^-?\d+$")))
    return whole.groupBy("criterion").agg(F.count("*").alias("n"), F.round(F.avg(F.col("score").cast("int")), 2).alias("mean"))


def final_turns(turns: DataFrame, is_final: str = "is_final", line: str = "text") -> DataFrame:
    """Final transcripts that aren't blank, stripped."""
    bare = F.regexp_replace(line, r"^\s+|\s+$", "")
    return turns.where(F.col(is_final) & (bare != "")).withColumn(line, bare)


def limit_or(k: int | None, default: int) -> int:
    """k, or the default if it is none or 0."""
    return k or default


def first_of(golden: DataFrame, n: int | None, *order: Column | str) -> DataFrame:
    """The first n rows in a stated order; all without n."""
    return golden.orderBy(*order).limit(n) if n else golden


def vocabulary(rows: DataFrame, label: str, *by: str) -> DataFrame:
    """by and the sorted distinct labels."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_set(label)).alias("labels"))


def rotation(*models: Column) -> Column:
    """Models in order, each once, without empty ones."""
    return F.array_distinct(F.filter(F.array(*models), lambda m: m.isNotNull() & (m != "")))


def settings(scenarios: DataFrame, profiles: DataFrame, domains: DataFrame) -> DataFrame:
    """scenarios (scenario, crm_profile, domain) with the columns of their profile and of their domain, by default DEFAULT_DOMAIN.

    A scenario whose profile or domain is unknown is left out, as it can't run.
    """
    named = scenarios.withColumn("domain", F.coalesce("domain", F.lit(DEFAULT_DOMAIN)))
    return named.join(profiles, "crm_profile").join(domains, "domain")


def redacted(rows: DataFrame) -> DataFrame:
    """rows with all text redacted: text columns, fields of structs at any depth, and texts in arrays; arrays of structs stay as they are."""

    def of(column: Column, kind) -> Column:
        if isinstance(kind, StringType):
            return rules.redact(column)
        if isinstance(kind, StructType):
            return F.when(column.isNotNull(), F.struct(*(of(column.getField(f.name), f.dataType).alias(f.name) for f in kind.fields)))
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, StringType):
            return F.transform(column, lambda x: rules.redact(x))
        return column

    return rows.select(*(of(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema.fields))


def cite(clause_id: Column, line: Column) -> Column:
    return F.concat(F.lit("["), clause_id, F.lit("] "), line)


def family_conflict(generator: Column, judge: Column, generator_backend: Column, judge_backend: Column) -> Column:
    """What is said where judge and generator are of one model family; null where they aren't."""
    said = F.format_string("judge and generator are both of family %s (generator %s, judge %s): groundedness is biased upward", judge, generator_backend, judge_backend)
    return F.when(generator == judge, said)


def looked_up(asked: DataFrame, lookup: Callable[[DataFrame], DataFrame] | None = None, key: str = "query_id") -> DataFrame:
    """key, summary, stub and error of each question (key, name, query): what a lookup gives, or a stand-in that quotes nothing.

    lookup is a function of the whole batch that returns key, summary and error. Without one, and for questions that it
    gives nothing for, the answer is a stub; an error is told, and is no answer either.
    """
    plain = asked.select(key, F.concat(F.col("name"), F.lit(": "), F.col("query")).alias("_said"))
    got = lookup(asked).select(key, "summary", "error") if lookup else plain.select(key, F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("error"))
    rows = plain.join(got, key, "left")
    stub = F.col("summary").isNull()
    return rows.select(key, F.when(stub, F.concat(F.lit("[stub] "), F.col("_said"))).otherwise(F.col("summary")).alias("summary"), stub.alias("stub"), "error")


def newest_traces(traces: DataFrame, key: str = "trace_id", *order: Column) -> DataFrame:
    """The trace of each id that was written last: what replacing on the id leaves of a table that is only appended to."""
    n = F.row_number().over(W.partitionBy(key).orderBy(*(order or (F.desc("written_at"),))))
    return traces.withColumn("_n", n).where("_n = 1").drop("_n")


def trace_latency(traces: DataFrame, began: str = "started", ended: str = "ended") -> DataFrame:
    """traces with latency_ms, from two timestamps."""
    return traces.withColumn("latency_ms", (F.unix_micros(ended) - F.unix_micros(began)) / F.lit(1000.0))


def scored_families(rows: DataFrame) -> DataFrame:
    """rows (gen_backend, gen_model, judge_backend, judge_model) with both families and what is to be said of them."""
    from .monitoring import family

    both = rows.withColumn("generator", family(F.col("gen_backend"), F.col("gen_model"))).withColumn("judge", family(F.col("judge_backend"), F.col("judge_model")))
    return both.withColumn("conflict", family_conflict(F.col("generator"), F.col("judge"), F.col("gen_backend"), F.col("judge_backend")))


