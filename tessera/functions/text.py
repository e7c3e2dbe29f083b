"""Text expressions: tokens, stems, token estimates, ids and cuts. All of them are columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def stem(token: Column) -> Column:
    """Folded umlauts and one suffix less, if LEAST_STEM letters stay.

    A lazy head makes the longest suffix win, which for this list is the first that fits.
    """
    folded = F.when(F.rlike(token, F.lit("[äöüß]")), F.replace(F.translate(token, "äöü", "aou"), F.lit("ß"), F.lit("ss"))).otherwise(token)
    return F.regexp_replace(folded, f"^(.{{{fixed.LEAST_STEM},}}?)({'|'.join(fixed.SUFFIXES)})$", "$1")


def tokens(text: Column) -> Column:
    """Lower-case content tokens, stemmed, repeats included."""
    low = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({fixed.TOKEN})"), F.lit(1)), F.lower)
    return F.transform(F.filter(low, lambda t: ~t.isin(fixed.STOP_WORDS) & ((F.length(t) > 1) | (t == "§"))), stem)


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / fixed.CHARS_A_TOKEN).cast("int"))


def let(value: Column, body) -> Column:
    """body of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Runs without Unicode white space, as plain ranges: a negated class of all white space is several times as slow.
BLACK = (
    r"([\x00-\x08\x0E-\x1B\x21-\x84\x86-\x9F\u00A1-\u167F\u1681-\u1FFF\u200B-\u2027\u202A-\u202E\u2030-\u205E\u2060-\u2FFF\u3001-\x{10FFFF}]+)"
)


def words(text: Column) -> Column:
    """White-space separated words; an empty array for blank text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(BLACK), F.lit(1))


def windows(text: Column, most: int = fixed.CHUNK_TOKENS, overlap: int = fixed.CHUNK_OVERLAP) -> Column:
    """Overlapping word windows of a text within a token budget; the text itself if it fits.

    Words a window follow from the text's own tokens a word; the last window is the first to
    reach the end.
    """

    def cut(w: Column) -> Column:
        n, per_word = F.size(w), F.greatest(F.lit(1.0), estimate_tokens(text) / F.size(w))
        wide = F.greatest(F.lit(1), F.floor(F.lit(most) / per_word).cast("int"))
        again = F.least(wide - 1, F.greatest(F.lit(0), F.floor(F.lit(overlap) / per_word).cast("int")))
        step = F.greatest(F.lit(1), wide - again)
        last = F.greatest(F.lit(0), F.ceil((n - wide) / step).cast("int"))
        pieces = F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(F.slice(w, k * step + 1, wide), " "))
        return F.when(n == 0, F.array(text)).otherwise(pieces)

    return F.when(estimate_tokens(text) <= most, F.array(text)).otherwise(let(words(text), cut))


def content_hash(model: Column, text: Column) -> Column:
    """Key of a cached vector."""
    return F.sha2(F.concat(model, F.lit("\0"), text), 256)


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID: a SHA-1 with the version and variant bits set."""
    h = F.sha1(F.concat(F.lit(bytearray(uuid.UUID(namespace).bytes)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat_ws("-", *parts)


def point_id(doc_id: Column, clause_id: Column) -> Column:
    return uuid5(fixed.POINT_NAMESPACE, F.concat(doc_id, F.lit("\0"), clause_id))


def summary(clause_id: Column, section: Column, text: Column) -> Column:
    """A line that quotes a clause, cut at the last space within SUMMARY_CHARS."""
    flat = F.replace(F.trim(text), F.lit("\n"), F.lit(" "))
    head = F.substring(flat, 1, fixed.SUMMARY_CHARS)
    cut = F.concat(F.when(F.contains(head, F.lit(" ")), F.regexp_replace(head, " [^ ]*$", "")).otherwise(head), F.lit("…"))
    return F.concat(F.lit("Laut "), clause_id, F.lit(" ("), section, F.lit("): "), F.when(F.length(flat) > fixed.SUMMARY_CHARS, cut).otherwise(flat))


def json_object(text: Column) -> Column:
    """The widest {...} of a text; null without one."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def any_of(text: Column, keywords: list[str]) -> Column:
    """Whether a lower-cased text contains one of the keywords anywhere."""
    low = F.lower(text)
    out = F.lit(False)
    for k in keywords:
        out = out | F.contains(low, F.lit(k))
    return out
