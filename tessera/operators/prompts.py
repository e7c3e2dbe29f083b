"""What an agent says and sees: openings, prompt blocks, lookups, panels and call metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import fixed, text

# What stands in for a missing name, the default opening and tags.
NOBODY = "there"
OPENING = "Guten Tag {first_name}, you're through to claims intake — I have your file open. How can I help you today? Is everyone okay?"
NO_SUMMARY, STUB_TAG = "(no summary)", " [stub — say something general, don't quote]"


def first_name(*names: Column) -> Column:
    """The first word of the first name that is there."""
    name = F.coalesce(*[F.nullif(n, F.lit("")) for n in names], F.lit(NOBODY))
    return F.get(text.words(name), F.lit(0))


def opening(template: Column, name: Column, company: Column) -> Column:
    """A template with {first_name}, {name} and {company} filled in; one with other fields stays as it is."""
    holder = F.coalesce(F.nullif(name, F.lit("")), F.lit(NOBODY))
    out = template
    for field, value in (("first_name", first_name(name)), ("company", F.coalesce(company, F.lit(""))), ("name", holder)):
        out = F.replace(out, F.lit("{" + field + "}"), value)
    odd = F.rlike(F.regexp_replace(template, r"\{(?:first_name|company|name)\}", ""), F.lit(r"\{[^{}]*\}"))
    return F.when(odd, template).otherwise(out)


def last_lookups(results: DataFrame, key: str = "call_id", n: int = fixed.LAST_TOOLS) -> DataFrame:
    """key and block: the newest n lookup results (key, seq, name, summary, stub) as quotable lines, oldest first."""
    newest = results.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc("seq")))).where(F.col("_n") <= n)
    shown = F.substring(F.coalesce("summary", F.lit(NO_SUMMARY)), 1, fixed.TOOL_SUMMARY_CHARS)
    line = F.concat(F.lit("  • "), F.coalesce("name", F.lit("?")), F.when(F.coalesce("stub", F.lit(False)), STUB_TAG).otherwise(""), F.lit(':\n    "'), shown, F.lit('"'))
    rows = newest.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("s"))
    return rows.select(key, F.array_join(F.transform("s", lambda x: x["line"]), "\n").alias("block"))


def last_reply(line: Column, n: int = fixed.REPLY_CHARS) -> Column:
    """A reply cut to n characters, marked if it was longer; empty for none."""
    bare = F.trim(F.coalesce(line, F.lit("")))
    return F.when(F.length(bare) > n, F.concat(F.substring(bare, 1, n), F.lit("…"))).otherwise(bare)


def assembled(*blocks: Column) -> Column:
    """Prompt blocks in order, empty ones left out."""
    return F.array_join(F.filter(F.array(*[F.coalesce(b, F.lit("")) for b in blocks]), lambda b: b != ""), "\n\n")


def room_phone(room: Column) -> Column:
    """The caller's number in a room name such as call-+49172…_abc: after the last -, up to the first _."""
    return F.split_part(F.element_at(F.split(room, "-"), -1), F.lit("_"), F.lit(1))


def sip_host(uri: Column) -> Column:
    """The host of a SIP address, without scheme, user, port and parameters."""
    return F.regexp_extract(uri, r"^(?:sips?:)?(?:[^@]*@)?([^:;>]+)", 1)


def known_callers(calls: DataFrame, profiles: DataFrame, default: str) -> DataFrame:
    """calls (phone) with the profile of their number; the default's where the number is unknown."""
    return calls.join(profiles.select("phone", "profile"), "phone", "left").withColumn("profile", F.coalesce("profile", F.lit(default)))


def whitelisted(rows: DataFrame, json: str, pillars: list[str], fraud: list[str]) -> DataFrame:
    """rows with kind, label and value of each known key of a JSON object whose value is text and not blank."""
    pairs = rows.select("*", F.explode(F.from_json(json, "map<string,string>")).alias("label", "value"))
    kind = F.when(F.col("label").isin(pillars), "pillar").when(F.col("label").isin(fraud), "fraud")
    return pairs.withColumn("kind", kind).where(F.col("kind").isNotNull() & (F.trim("value") != ""))


def panel(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field and value of the fields that are there: a profile as lines of a panel."""
    return rows.select(key, *[F.col(f).cast("string") for f in fields]).unpivot(key, fields, "field", "value").where("value IS NOT NULL AND value <> ''")


def verdict_rates(verdicts: DataFrame, by: str) -> DataFrame:
    """by, n, human_rate and mean_score; scores that are no integers are left out, a mean of none is 0."""
    score = F.expr("try_cast(score AS int)")
    return verdicts.groupBy(by).agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("verdict") == "human").cast("double")), 4).alias("human_rate"), F.round(F.coalesce(F.avg(score), F.lit(0.0)), 4).alias("mean_score")
    )


def coverage_of(chunks: DataFrame):
    """A function of questions (query_id, query) that answers them from the chunks: what a tool call runs, as one batch."""
    from . import retrieval

    def lookup(questions: DataFrame) -> DataFrame:
        recalled = retrieval.bm25(chunks, questions)
        return retrieval.answers(questions, retrieval.lexical_rerank(recalled, chunks, questions), chunks)

    return lookup
