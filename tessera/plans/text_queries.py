"""Queries of the text kernel, chunking and redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import fixed, rules, text
from tessera.operators import chunking

from .registry import query, table

STOP_SQL = ", ".join(f"'{w}'" for w in sorted(set(fixed.STOP_WORDS)))


def tokens_sql(expr: str) -> str:
    """A DuckDB expression for the content tokens of a text expression."""
    low = f"list_transform(regexp_extract_all({expr}, '{fixed.TOKEN}'), lambda t: lower(t))"
    kept = f"list_filter({low}, lambda t: t NOT IN ({STOP_SQL}) AND (length(t) > 1 OR t = '§'))"
    return f"list_transform({kept}, lambda t: regexp_replace(replace(translate(t, 'äöü', 'aou'), 'ß', 'ss'), '^(.{{4,}}?)(ern|en|er|es|e|n|s)$', '\\1'))"


WINDOWS_SQL = r"""
  words AS (
    SELECT *, list_filter(regexp_split_to_array(trim(text, E' \t\n\r\x0b\x0c'), '\s+'), lambda w: w <> '') AS w,
           greatest(1, length(text) // 4) AS est FROM src),
  sizes AS (
    SELECT *, len(w) AS n, greatest(1, floor(400 / greatest(1.0::DOUBLE, est::DOUBLE / nullif(len(w), 0))))::INT AS wide,
           greatest(0, floor(64 / greatest(1.0::DOUBLE, est::DOUBLE / nullif(len(w), 0))))::INT AS lap FROM words),
  steps AS (SELECT *, greatest(1, wide - least(wide - 1, lap)) AS step FROM sizes),
  cuts AS (
    SELECT *, unnest(CASE WHEN est <= 400 OR n = 0 THEN [0] ELSE range(0, greatest(0, ceil((n - wide)::DOUBLE / step))::INT + 1) END)::INT AS win FROM steps),
  pieces AS (
    SELECT *, CASE WHEN est <= 400 OR n = 0 THEN text ELSE array_to_string(w[win * step + 1 : win * step + wide], ' ') END AS piece FROM cuts)
"""


def corpus(spark, sf_dir):
    """documents as corpus documents: source plays the product code."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("policy").alias("doc_type"), F.col("source").alias("product_code"), "lang", F.coalesce("text", F.lit("")).alias("text"))


@query(
    "text_tokens",
    f"""SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_distinct, array_to_string(t, ' ') AS tokens
    FROM (SELECT doc_id, {tokens_sql("coalesce(text, '')")} AS t FROM documents)""",
)
def text_tokens(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.array_join("t", " ").alias("tokens"))


@query(
    "chunk_windows",
    f"""WITH src AS (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents), {WINDOWS_SQL}
    SELECT doc_id, coalesce(source, doc_id::VARCHAR) || ':root' || CASE WHEN win > 0 THEN '#' || win ELSE '' END AS clause_id, win AS "window",
           greatest(1, length(piece) // 4)::INT AS token_count, sha256('BAAI/bge-m3' || chr(0) || piece) AS cache_key
    FROM pieces""",
)
def chunk_windows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    cut = d.select("doc_id", "source", F.posexplode(text.windows(F.col("text"))).alias("window", "piece"))
    clause = F.concat(F.coalesce("source", F.col("doc_id").cast("string")), F.lit(":root"))
    named = F.when(F.col("window") > 0, F.concat(clause, F.lit("#"), F.col("window").cast("string"))).otherwise(clause)
    return cut.select("doc_id", named.alias("clause_id"), "window", text.estimate_tokens(F.col("piece")).alias("token_count"), text.content_hash(F.lit("BAAI/bge-m3"), F.col("piece")).alias("cache_key"))


MARKED_SQL = r"""'Vorspann ' || doc_id || E'\nTeil A: Umfang\n\n§ ' || (doc_id % 30 + 1) || E' Erstes\n' || coalesce(text, '')
    || E'\n4.2 Hoehe der Leistung\nBetrag gemaess § 7 gilt.\n  § 2b Zweites\n' || coalesce(source, '')"""


def marked(spark, sf_dir):
    """Documents with structure markers put around their text."""
    d = table(spark, sf_dir, "documents")
    body = F.concat(
        F.lit("Vorspann "), F.col("doc_id").cast("string"), F.lit("\nTeil A: Umfang\n\n§ "), (F.col("doc_id") % 30 + 1).cast("string"), F.lit(" Erstes\n"),
        F.coalesce("text", F.lit("")), F.lit("\n4.2 Hoehe der Leistung\nBetrag gemaess § 7 gilt.\n  § 2b Zweites\n"), F.coalesce("source", F.lit("")),
    )
    return d.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("policy").alias("doc_type"), F.col("source").alias("product_code"), "lang", body.alias("text"))


@query(
    "structure_sections",
    rf"""WITH m AS (SELECT doc_id, {MARKED_SQL} AS body FROM documents),
    s AS (SELECT doc_id, regexp_replace(body, '(?m)^(\s*(?:§\s*\d+[a-z]?|Teil\s+[A-Z0-9]+|\d+(?:\.\d+)*\s+\S))', chr(1) || '\1', 'g') AS cut FROM m),
    p AS (SELECT doc_id, string_split(cut, chr(1))[2:] AS parts FROM s),
    u AS (SELECT doc_id, unnest(range(0, len(parts)))::INT AS seq, unnest(parts) AS part FROM p),
    e AS (SELECT doc_id, seq, trim(regexp_extract(part, '(?m)^\s*(§\s*\d+[a-z]?|Teil\s+[A-Z0-9]+|\d+(?:\.\d+)*\s+\S)', 1), E' \t\n\r\x0b\x0c') AS marker, trim(part, E' \t\n\r\x0b\x0c') AS section FROM u)
    SELECT doc_id, seq, marker, section, starts_with(marker, 'Teil') AND NOT regexp_matches(section, '[.!?]') AND length(section) < 80 AS container FROM e""",
)
def structure_sections(spark, sf_dir):
    s = chunking.sections(marked(spark, sf_dir))
    return s.select(F.col("doc_id").cast("long").alias("doc_id"), "seq", "marker", "section", chunking.is_container(F.col("marker"), F.col("section")).alias("container"))


@query(
    "structure_chunks",
    rf"""WITH m AS (SELECT doc_id, source, lang, {MARKED_SQL} AS body FROM documents),
    s AS (SELECT doc_id, source, lang, regexp_replace(body, '(?m)^(\s*(?:§\s*\d+[a-z]?|Teil\s+[A-Z0-9]+|\d+(?:\.\d+)*\s+\S))', chr(1) || '\1', 'g') AS cut FROM m),
    u AS (SELECT doc_id, source, lang, unnest(string_split(cut, chr(1))[2:]) AS part FROM s),
    e AS (SELECT doc_id, source, lang, trim(regexp_extract(part, '(?m)^\s*(§\s*\d+[a-z]?|Teil\s+[A-Z0-9]+|\d+(?:\.\d+)*\s+\S)', 1), E' \t\n\r\x0b\x0c') AS marker, trim(part, E' \t\n\r\x0b\x0c') AS text FROM u),
    src AS (SELECT * FROM e WHERE text <> '' AND NOT (starts_with(marker, 'Teil') AND NOT regexp_matches(text, '[.!?]') AND length(text) < 80)), {WINDOWS_SQL}
    SELECT doc_id::VARCHAR AS doc_id, marker AS section_path, coalesce(source, doc_id::VARCHAR) || ':' || marker || CASE WHEN win > 0 THEN '#' || win ELSE '' END AS clause_id,
           lang, greatest(1, length(piece) // 4)::INT AS token_count, piece AS text FROM pieces""",
)
def structure_chunks(spark, sf_dir):
    return chunking.chunks(marked(spark, sf_dir)).select("doc_id", "section_path", "clause_id", "lang", "token_count", "text")


RAW_SQL = r"""CASE doc_id % 3 WHEN 0 THEN E'---\ndoc_id: D' || doc_id || E'\nlang: ' || coalesce(lang, '') || E'\nproduct_code: \n---\n\n' || coalesce(text, '')
    WHEN 1 THEN E'---\nlang: en\n' || coalesce(text, '') ELSE coalesce(text, '') END"""


@query(
    "front_matter_documents",
    rf"""WITH r AS (SELECT doc_id AS n, {RAW_SQL} AS raw FROM documents),
    s AS (SELECT n, raw, starts_with(raw, '---') AND strpos(raw[4:], E'\n---') > 0 AS has, strpos(raw[4:], E'\n---') AS pos FROM r),
    b AS (SELECT n, CASE WHEN has THEN raw[4 : pos + 2] END AS header, CASE WHEN has THEN raw[pos + 7 :] ELSE raw END AS body FROM s)
    SELECT coalesce(nullif(regexp_extract(coalesce(header, ''), '(?m)^doc_id:[ \t]*(.*?)[ \t]*$', 1), ''), 'f' || n) AS doc_id, 'policy' AS doc_type,
           nullif(regexp_extract(coalesce(header, ''), '(?m)^product_code:[ \t]*(.*?)[ \t]*$', 1), '') AS product_code,
           coalesce(nullif(regexp_extract(coalesce(header, ''), '(?m)^lang:[ \t]*(.*?)[ \t]*$', 1), ''), 'de') AS lang,
           trim(body, E' \t\n\r\x0b\x0c') AS text, 'corpus/f' || n || '.md' AS source_path FROM b""",
)
def front_matter_documents(spark, sf_dir):
    t, n = F.coalesce("text", F.lit("")), F.col("doc_id").cast("string")
    with_header = F.concat(F.lit("---\ndoc_id: D"), n, F.lit("\nlang: "), F.coalesce("lang", F.lit("")), F.lit("\nproduct_code: \n---\n\n"), t)
    raw = F.when(F.col("doc_id") % 3 == 0, with_header).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("---\nlang: en\n"), t)).otherwise(t)
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("corpus/f"), n, F.lit(".md")).alias("path"), raw.alias("raw"))
    return chunking.documents(files)


#: Rules that SQL without look-ahead can express.
PLAIN_RULES = [r for r in fixed.REDACTIONS if r[0] != "DL"]


def redact_sql(expr: str) -> str:
    for _, pattern, token in PLAIN_RULES:
        expr = f"regexp_replace({expr}, '{pattern}', '{token}', 'g')"
    return expr


@query("redaction_turns", f"SELECT conv_id, turn, {redact_sql('text')} AS text FROM conversations")
def redaction_turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", rules.redact(F.col("text"), PLAIN_RULES).alias("text"))


ID_TEXT_SQL = r"""'policy DE-HUK-2024-' || lpad(event_id::VARCHAR, 6, '0') || ', plate B-MM ' || (user_id % 9000 + 10) || ', mail u' || user_id || '@mail.example.de, born 19'
    || lpad((event_id % 90 + 10)::VARCHAR, 2, '0') || '-03-15, card 4242 4242 4242 ' || lpad((event_id % 10000)::VARCHAR, 4, '0') || '.'"""


@query("redaction_ids", f"SELECT event_id, {redact_sql('raw')} AS text FROM (SELECT event_id, {ID_TEXT_SQL} AS raw FROM events)")
def redaction_ids(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = lambda c: F.col(c).cast("string")
    raw = F.concat(
        F.lit("policy DE-HUK-2024-"), F.lpad(s("event_id"), 6, "0"), F.lit(", plate B-MM "), (F.col("user_id") % 9000 + 10).cast("string"), F.lit(", mail u"), s("user_id"), F.lit("@mail.example.de, born 19"),
        F.lpad((F.col("event_id") % 90 + 10).cast("string"), 2, "0"), F.lit("-03-15, card 4242 4242 4242 "), F.lpad((F.col("event_id") % 10000).cast("string"), 4, "0"), F.lit("."),
    )
    return e.select("event_id", rules.redact(raw, PLAIN_RULES).alias("text"))


@query("redaction_documents")
def redaction_documents(spark, sf_dir):
    """All rules over the documents; the look-ahead of one has no SQL oracle."""
    return table(spark, sf_dir, "documents").select("doc_id", rules.redact(F.col("text")).alias("text"))


@query(
    "blank_line_blocks",
    r"""WITH b AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(coalesce(text, ''), E'\\.\n', E'.\n\n', 'g'), '\n\s*\n')) AS block FROM documents)
    SELECT doc_id, count(*) AS n_blocks, max(length(trim(block, E' \t\n\r\x0b\x0c'))) AS longest FROM b
    WHERE length(trim(block, E' \t\n\r\x0b\x0c')) >= 30 GROUP BY doc_id""",
)
def blank_line_blocks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"\.\n", ".\n\n").alias("t"))
    b = d.select("doc_id", F.explode(F.split("t", r"\n\s*\n")).alias("block")).withColumn("size", F.length(F.regexp_replace("block", r"^\s+|\s+$", "")).cast("long"))
    return b.where("size >= 30").groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.max("size").alias("longest"))


@query(
    "json_salvage",
    r"""SELECT event_id, nullif(regexp_extract('note: ' || coalesce(props, '') || ' end', '(?s)\{.*\}', 0), '') AS object FROM events""",
)
def json_salvage(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.json_object(F.concat(F.lit("note: "), F.coalesce("props", F.lit("")), F.lit(" end"))).alias("object"))
