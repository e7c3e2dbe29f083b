"""Pattern rules over text columns: redaction, extraction, intents, emotion, triggers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import fixed
from .text import any_of


def redact(text: Column, rules: list | None = None) -> Column:
    """text with personal data replaced by tokens, rule after rule."""
    for _, pattern, token in rules if rules is not None else fixed.REDACTIONS:
        text = F.regexp_replace(text, f"(?U){pattern}", token.replace("$", r"\$"))
    return text


def emotion(text: Column) -> Column:
    out = F.lit("calm")
    for name, pattern in reversed(fixed.EMOTIONS):
        out = F.when(F.rlike(F.lower(text), F.lit(f"(?U){pattern}")), F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit("calm"))


def intents(text: Column, rules: dict | None = None) -> Column:
    """Sorted ids of the pillars that a reply asks about; none for null or empty text."""
    hit = [F.when(F.rlike(text, F.lit("|".join(f"(?iU:{p})" for p in patterns))), F.lit(name)) for name, patterns in (rules or fixed.INTENTS).items()]
    return F.array_sort(F.array_compact(F.array(*hit)))


def lookups(text: Column) -> Column:
    """Names of the lookups that a caller's line triggers, in order."""
    named = [("weather", fixed.WEATHER_WORDS), ("towing", fixed.TOWING_WORDS), ("coverage", fixed.COVERAGE_WORDS)]
    return F.array_compact(F.array(*[F.when(any_of(text, words), F.lit(name)) for name, words in named]))


def mode(text: Column, current: Column) -> Column:
    return F.when(any_of(text, fixed.DISTRESS_WORDS), "distressed").when(any_of(text, fixed.NOISE_WORDS), "noisy").otherwise(current)


def place(text: Column) -> Column:
    """The first phrase that holds the first of PLACES found in the text; null without one."""
    low, out = F.lower(text), F.lit(None).cast("string")
    phrases = F.split(text, "[,.!?;]")
    for key in reversed(fixed.PLACES):
        out = F.when(F.contains(low, F.lit(key)), F.trim(_first_with(phrases, key))).otherwise(out)
    return out


def _first_with(phrases: Column, key: str) -> Column:
    return F.get(F.filter(phrases, lambda p: F.contains(F.lower(p), F.lit(key))), F.lit(0))


def spans(turns: DataFrame, keys: list[str], text: str = "text", rules: list | None = None) -> DataFrame:
    """(keys, kind, label, value, score, seq): every match of every rule; seq is the order that breaks ties.

    All rules run over a row in one pass; nothing is shuffled.
    """
    found = [_found(F.col(text), n, *rule) for n, rule in enumerate(rules or fixed.EXTRACTIONS)]
    return turns.select(*keys, F.explode(F.flatten(F.array(*found))).alias("s")).select(*keys, "s.*")


def _found(text: Column, n: int, kind: str, label: str, pattern: str, group: int, value: str | None, score: float, free: bool) -> Column:
    hits = F.regexp_extract_all(text, F.lit(f"(?{'iu' if free else ''}U){pattern}"), F.lit(group))

    def span(hit, i):
        own = F.lit(value) if value else hit
        return F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), own.alias("value"), F.lit(score).alias("score"), (F.lit(n * 1000) + i).alias("seq"))

    return F.transform(hits, span)


def extract(turns: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, kind, label, value, score): the best span of each label; the first of equal scores."""
    best = W.partitionBy(*keys, "kind", "label").orderBy(F.desc("score"), "seq")
    return spans(turns, keys, text).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "seq")


def merged(base: DataFrame, overlay: DataFrame, keys: list[str]) -> DataFrame:
    """Spans of two extractions, the overlay's only where its score is strictly higher."""
    both = base.withColumn("_from", F.lit(0)).unionByName(overlay.withColumn("_from", F.lit(1)))
    best = W.partitionBy(*keys, "kind", "label").orderBy(F.desc("score"), "_from")
    return both.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_from")
