"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

WEIGHTS = (5, 2, 1)
SEED = "mix"
BLOCK_WORDS = 4096
#: Slots that one task draws at once.
DRAW = 100_000
#: Hexadecimal digits of a digest that name a part of a source's stream.
PART_DIGITS = 4
#: Slots are numbers of so many bits; words of a partition of the mixed texts.
SLOT_BITS, PARTITION_WORDS = 62, 1 << 23


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null: null sources are a source of their own."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))


def running(rows: DataFrame, key: str, part: str, order: list, value: Column, name: str) -> DataFrame:
    """rows with the sum of `value` over the rows before, within `key`, ordered by part and order.

    Sums of the parts are added up in a small table, and each part on its own, so that
    a key with most of all rows is spread over as many tasks as it has parts.
    """
    sums = rows.groupBy(key, part).agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(key).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(key, part, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = W.partitionBy(key, part).orderBy(*order)
    local = rows.withColumn("_to", F.sum(value).over(within.rowsBetween(W.unboundedPreceding, 0))).withColumn("_row", F.row_number().over(within))
    return local.join(starts, [key, part]).withColumn(name, F.col("_start") + F.col("_to") - value).drop("_start", "_to")


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """(key, source_size, target) from one row (key, source, source_size) a source.

    Sources in code point order, null last, take the weights in turn and share
    `share` times all words by them; none gets more than `cap` times its own size, and the
    rest is shared again by weight. In order of cap over weight the sources at their cap
    come first, so one pass finds the level at which the others share what is left.
    """
    ranked = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(ranked) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("turn", F.row_number().over(ranked)).withColumn("weight", turn.cast("double")).withColumn("cap", F.col("source_size") * F.lit(cap))
    filled = W.orderBy(F.col("cap") / F.col("weight"), "turn")
    total = F.sum("source_size").over(W.partitionBy()) * F.lit(share)
    s = s.withColumn("level", (total - F.coalesce(F.sum("cap").over(filled.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(filled.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("full", F.col("cap") / F.col("weight") <= F.col("level"))
    level = F.min_by("level", F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("turn")))).over(W.partitionBy())
    return s.select("key", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("weight") * level, F.col("cap"))).alias("target"))


def bit_reversed(x: Column) -> Column:
    """The 62 low bits of x in reverse: van der Corput's order of a grid."""
    for shift, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        m = F.lit(mask)
        x = F.shiftleft(x.bitwiseAND(m), shift).bitwiseOR(F.shiftrightunsigned(x, shift).bitwiseAND(m))
    x = F.shiftleft(x, 32).bitwiseOR(F.shiftrightunsigned(x, 32))
    return F.shiftrightunsigned(x, 2)


def schedule(plan: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(key, block, slot): the slot at which a source's block number `block` is due.

    plan has key, turn order by key, and quota, the words to take. All sources' slots are points of van
    der Corput's sequence: its grid of a power of two of points, no fewer than the slots, is laid through
    the cumulative shares of the sources, so that any stretch of the schedule has
    close to the target proportions. A source's points are ranked by their place in the sequence;
    it takes as many of the first as it has blocks.
    """
    need = plan.withColumn("blocks", F.ceil(F.col("quota") / block_words).cast("long"))
    upto = F.sum("blocks").over(W.orderBy("key").rowsBetween(W.unboundedPreceding, 0))
    all_blocks = F.sum("blocks").over(W.partitionBy())
    need = need.withColumn("upto", upto).withColumn("all", all_blocks).where("blocks > 0")
    need = need.withColumn("grid", F.expr("shiftleft(1L, cast(ceil(log2(all)) as int))"))
    lo, hi = (F.expr(f"(cast({x} as decimal(19,0)) * cast(grid as decimal(19,0))) div all") for x in ("upto - blocks", "upto"))
    drawn = need.select("key", "blocks", lo.alias("lo"), hi.alias("hi")).withColumn("at", F.explode(F.expr(f"sequence(lo, hi - 1, {DRAW}L)")))
    points = drawn.repartition("key", "at").select("key", "blocks", F.explode(F.expr(f"sequence(at, least(at + {DRAW - 1}, hi - 1))")).alias("point"))
    points = points.withColumn("slot", bit_reversed(F.col("point")))
    parts = F.shiftrightunsigned(F.col("slot"), 54).cast("int")
    ranked = running(points.withColumn("part", parts), "key", "part", ["slot"], F.lit(1).cast("long"), "block")
    return ranked.where("block < blocks").select("key", "block", "slot")


def pieces(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """What the mix takes: a row for each stretch of a document in a block of the schedule.

    Columns: doc_id, source, place (part and row, which tell repeated rows apart), size, source_size, target, round (which time
    through the stream), slot (order of the mix), at (the stretch's first word in the source's repeated stream), start (its first word in the document) and
    length. What no slot was drawn for is not taken: documents that give nothing have one row of null slot and length 0. Where docs has a
    column uid, it is kept.

    A source's documents are shuffled by a digest of their ids and stand in one stream of words,
    which is read from its start again when it ends. The stream is cut into blocks of `block_words`
    words up to the source's target, rounded; the last block is shorter. Blocks join the slots that the schedule draws for their source.
    Null texts and texts without words have size 0; a null source is a source; equal
    ids, null ones too, keep a row each. An empty table gives no rows. Only doc_id, text, source and uid are read, so further columns of any
    name don't matter.
    """
    own = [c for c in ("uid",) if c in docs.columns]
    digest = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = written(docs.select(*own, "doc_id", "source", source_key(F.col("source")).alias("key"), word_count(F.col("text")).alias("size"), digest.alias("digest")))
    sized = sized.withColumn("part", F.conv(F.substring("digest", 1, PART_DIGITS), 16, 10).cast("int"))
    sizes = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, share, cap, weights).withColumn("quota", F.floor(F.col("target") + 0.5).cast("long"))
    slots = schedule(plan.select("key", "quota"), block_words)
    placed = running(sized, "key", "part", ["digest", "doc_id", "size", *own], F.col("size"), "at").join(plan, "key")
    # the document's words in each round through the stream, as far as the quota goes
    rounds = placed.withColumn("round", F.explode(F.expr(f"sequence(0, {int(cap) - (int(cap) == cap)})")))
    lo = F.col("at") + F.col("round") * F.col("source_size")
    rounds = rounds.withColumn("lo", lo).withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("quota")))
    blocks = F.when(F.col("lo") < F.col("hi"), F.expr(f"sequence(lo div {block_words}, (hi - 1) div {block_words})"))
    rounds = rounds.where((F.col("round") == 0) | (F.col("lo") < F.col("hi"))).withColumn("block", F.explode_outer(blocks))
    start, end = F.greatest(F.col("lo"), F.col("block") * block_words), F.least(F.col("hi"), (F.col("block") + 1) * block_words)
    cut = rounds.withColumn("from", start).withColumn("upto", end).join(slots, ["key", "block"], "left")
    return cut.select(
        *own, "doc_id", "source", F.struct("part", "_row").alias("place"), "size", "source_size", "target", "round", "slot",
        F.col("from").alias("at"), (F.col("from") - F.col("lo")).alias("start"), F.when(F.col("slot").isNull(), F.lit(0)).otherwise(F.col("upto") - F.col("from")).alias("length"),
    )


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words in the blocks of drawn slots, repeats counted) of every row; see `pieces`."""
    by = ["doc_id", "source", "place", "size", "source_size", "target"]
    return pieces(docs, **options).groupBy(*by).agg(F.sum("length").alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs repeated and cut as the mix takes them, in order of the schedule, with the columns of docs.

    A document taken more than once has a row for each time; where the source's target ends within it, the row holds its first
    words, and n_chars follows the text. Each row stands at the slot of its first block. Rows are told apart by a number of their
    own: repeated rows, and those of null or repeated ids, are taken each for itself. Columns of docs may have any names.
    """
    base = written(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.monotonically_increasing_id().alias("uid")))
    own = pieces(base.select("uid", *(F.col(f"row.{c}").alias(c) for c in ("doc_id", "text", "source"))), **options).where("length > 0")
    dose = own.groupBy("uid", "round", "size").agg(F.sum("length").alias("words"), F.min_by("slot", "start").alias("slot"), F.min("at").alias("at"))
    dose = written(dose)
    parts = max(1, -(-(dose.agg(F.sum("words")).first()[0] or 0) // PARTITION_WORDS))
    place = F.shiftright(F.shiftright("slot", SLOT_BITS - 24) * F.lit(parts).cast("long"), 24).cast("int")
    out = base.join(dose, "uid").repartitionById(parts, place).sortWithinPartitions("slot", "at", "uid")
    text = F.when(F.col("words") == F.col("size"), F.col("row.text")).otherwise(_first_words(F.col("row.text"), F.col("words")))
    out = out.select("row", text.alias("text"))
    value = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*(value.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def _first_words(text: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0)), F.lit(1), n.cast("int")), "")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix' || coalesce(doc_id::VARCHAR, '')) AS digest
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
turns AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS turn FROM sizes),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((turn - 1) % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS cap FROM turns),
levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
water AS (SELECT level FROM levels WHERE NOT cap / weight <= level ORDER BY cap / weight, turn LIMIT 1),
plan AS (
  SELECT source, source_size, CASE WHEN cap / weight <= level THEN cap ELSE least(weight * (SELECT level FROM water), cap) END AS target
  FROM levels),
placed AS (
  SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY digest, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before
  FROM sized),
joined AS (SELECT p.*, source_size, target, floor(target + 0.5)::BIGINT AS quota FROM placed p JOIN plan q ON p.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE (quota // source_size) * size + greatest(0, least(size, quota - (quota // source_size) * source_size - before)) END::BIGINT AS taken
FROM joined
"""
