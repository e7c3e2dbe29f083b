"""Annotated transcripts into word spans for training."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels that training spans may have, the marker format and the least examples.
TARGET_LABELS = [
    "accident_location", "accident_time", "weather_conditions", "road_type", "other_party_plate", "other_party_name",
    "other_party_insurer", "police_case_number", "injury_description", "vehicle_drivable", "fault_admission",
    "settlement_preference", "delayed_reporting", "known_to_other_party", "vehicle_listed_for_sale",
]
MARKER = r"\[\[([a-z_]+):([^\[\]]+?)\]\]"
LEAST_CHARS, LEAST_SPANS = 30, 2


def word_spans(text: str, labels=frozenset(TARGET_LABELS)) -> tuple[list[str], list[tuple[int, int, str]]]:
    """(words, spans) of a text with [[label:phrase]] markers; a span runs from the first word that starts in the
    phrase to the last that starts before its end. Unknown labels and phrases without a word give none."""
    plain, marks, at = "", [], 0
    for m in re.finditer(MARKER, text):
        plain += text[at : m.start()]
        phrase = m[2].strip()
        marks.append((len(plain), len(plain) + len(phrase), m[1]))
        plain, at = plain + phrase, m.end()
    plain += text[at:]
    starts = [m.start() for m in re.finditer(r"\S+", plain)]
    spans = []
    for lo, hi, label in marks:
        first = next((i for i, s in enumerate(starts) if s >= lo), None)
        last = sum(s < hi for s in starts) - 1
        if label in labels and first is not None and first <= last:
            spans.append((first, last, label))
    return plain.split(), spans


SPANS = "struct<tokenized_text: array<string>, ner: array<struct<start: int, end: int, label: string>>>"


def _parse(texts: pa.Array) -> pa.Array:
    kind = pa.struct([("tokenized_text", pa.list_(pa.string())), ("ner", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())])))])
    out = []
    for t in texts.to_pylist():
        words, spans = word_spans(t or "")
        out.append({"tokenized_text": words, "ner": [{"start": a, "end": b, "label": x} for a, b, x in spans]})
    return pa.array(out, kind)


def examples(rows: DataFrame, text: str = "text") -> DataFrame:
    """tokenized_text and ner of the blank-line separated blocks that are long enough and have spans enough."""
    block = F.trim(F.col("block"))
    blocks = rows.select(F.explode(F.split(F.col(text), r"\n\s*\n")).alias("block")).select(block.alias("block"))
    blocks = blocks.where((F.length("block") >= LEAST_CHARS) & F.contains("block", F.lit("[[")))
    return blocks.select(F.arrow_udf(_parse, SPANS)("block").alias("e")).select("e.*").where(F.size("ner") >= LEAST_SPANS)


def unmarked(text: Column) -> Column:
    """text with its markers replaced by their phrases."""
    return F.regexp_replace(text, MARKER, "$2")
