"""Corpus documents into citable clause chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import fixed, text


def front_matter(raw: Column) -> tuple[Column, Column]:
    """(header, body): the header between an opening --- and the next line that starts with ---.

    Without either the whole text is the body.
    """
    pattern = r"(?s)\A---(.*?)\n---\n*(.*)\z"
    has = F.rlike(raw, F.lit(pattern))
    header = F.when(has, F.trim(F.regexp_extract(raw, pattern, 1)))
    return header, F.when(has, F.regexp_extract(raw, pattern, 2)).otherwise(raw)


def field(header: Column, name: str) -> Column:
    """A scalar of a header's `name: value` lines, quotes taken off; null if missing, empty or null."""
    value = F.regexp_extract(header, rf"(?m)^{name}:[ \t]*(.*?)[ \t]*$", 1)
    bare = F.regexp_replace(value, r"""^(['"])(.*)\1$""", "$2")
    return F.when(~bare.isin("", "null", "~"), bare)


def documents(files: DataFrame, path: str = "path", raw: str = "raw") -> DataFrame:
    """doc_id, doc_type, product_code, lang, text and source_path of raw corpus files, with defaults."""
    header, body = front_matter(F.col(raw))
    name = F.regexp_extract(F.col(path), r"([^/]*?)(\.[^./]*)?$", 1)
    return files.select(
        F.coalesce(field(header, "doc_id"), name).alias("doc_id"),
        F.coalesce(field(header, "doc_type"), F.lit("policy")).alias("doc_type"),
        field(header, "product_code").alias("product_code"),
        F.coalesce(field(header, "lang"), F.lit("de")).alias("lang"),
        F.regexp_replace(body, r"(?U)^\s+|\s+$", "").alias("text"),
        F.col(path).alias("source_path"),
    )


def sections(docs: DataFrame, body: str = "text") -> DataFrame:
    """docs with seq, marker and section: a row for each stretch that a structure marker begins.

    Text before the first marker is dropped; a text without markers is one section without one.
    """
    cut = "\u0001"
    found = F.regexp_replace(F.col(body), rf"(?mdU)^(\s*(?:{fixed.MARKER}))", cut + "$1")
    parts = F.split(found, cut)
    own = F.when(F.size(parts) > 1, F.slice(parts, 2, F.size(parts))).otherwise(parts)
    rows = docs.withColumn("_marked", F.size(parts) > 1).select("*", F.posexplode(own).alias("seq", "_part"))
    marker = F.when(F.col("_marked"), F.regexp_replace(F.regexp_extract("_part", rf"(?mdU)^\s*({fixed.MARKER})", 1), r"(?U)^\s+|\s+$", "")).otherwise("")
    return rows.withColumn("marker", marker).withColumn("section", F.regexp_replace("_part", r"(?U)^\s+|\s+$", "")).drop("_part", "_marked")


def is_container(marker: Column, section: Column) -> Column:
    """A bare heading that only holds other clauses."""
    return F.startswith(marker, F.lit(fixed.CONTAINER)) & ~F.rlike(section, F.lit("[.!?]")) & (F.length(section) < fixed.CONTAINER_CHARS)


def chunks(docs: DataFrame, most: int = fixed.CHUNK_TOKENS, overlap: int = fixed.CHUNK_OVERLAP) -> DataFrame:
    """id, doc_id, section_path, clause_id, doc_type, product_code, lang, token_count, text and seq of each clause.

    docs: doc_id, doc_type, product_code, lang and text. One pass over the rows, without a shuffle.
    """
    s = sections(docs).where((F.col("section") != "") & ~is_container(F.col("marker"), F.col("section")))
    s = s.withColumnRenamed("seq", "section_seq").select("*", F.posexplode(text.windows(F.col("section"), most, overlap)).alias("window", "piece"))
    path = F.when(F.col("marker") == "", "root").otherwise(F.col("marker"))
    clause = F.concat(F.coalesce(F.nullif(F.col("product_code"), F.lit("")), F.col("doc_id")), F.lit(":"), path)
    s = s.withColumn("clause_id", F.when(F.col("window") > 0, F.concat(clause, F.lit("#"), F.col("window").cast("string"))).otherwise(clause))
    return s.select(
        text.point_id(F.col("doc_id"), F.col("clause_id")).alias("id"), "doc_id", path.alias("section_path"), "clause_id", "doc_type", "product_code", "lang",
        text.estimate_tokens(F.col("piece")).alias("token_count"), F.col("piece").alias("text"), (F.col("section_seq") * 100_000 + F.col("window")).alias("seq"),
    )
