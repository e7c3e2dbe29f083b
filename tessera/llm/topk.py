"""Exact top-k inner products over norm-sorted vectors with rotated partial sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Rows of a block of candidates, and of a block of queries.
BLOCK, QUERIES = 4096, 1024
#: Dimensions after which partial sums are bounded.
STEPS = (4, 8, 16, 32)
#: Rows of either kind that give the floors.
SEEDS = 2048


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(row, id, v, size, norm2) of the rows that take part: floor(scale * x) of each component as long.

    Rows of null id, and vectors null or with null or non-finite components, take no part. `row` numbers the rows, so
    that rows that repeat an id stay rows of their own; it must be written before it is used twice.
    """
    v = F.col(vector_col).cast("array<double>")
    fit = F.col(id_col).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ints = F.transform(v, lambda x: F.floor(x * F.lit(float(scale))))
    rows = vectors.where(fit).select(F.col(id_col).cast("long").alias("id"), ints.alias("v"))
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", "v", F.size("v").alias("size"), norm2.alias("norm2"))


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """Orthonormal columns, the directions of all rows' largest second moments first."""

    def moments(batches):
        total = np.zeros((width, width))
        for b in batches:
            x = padded(b["v"], width).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width), pa.int32()), pa.array(total.ravel())], names=["at", "m"])

    m = np.zeros(width * width)
    for r in rows.select("v").mapInArrow(moments, "at int, m double").groupBy("at").agg(F.sum("m").alias("m")).collect():
        m[r["at"]] = r["m"]
    _, _, vt = np.linalg.svd(m.reshape(width, width) / max(1.0, np.abs(m).max()))
    return vt.T


def padded(lists, width: int) -> np.ndarray:
    """A list array as a matrix of longs; shorter vectors end in zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat, n = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), width), np.int64)
    if len(flat):
        out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def exact_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products, by floats where these are exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    return (q.astype(float) @ c.astype(float).T).astype(np.int64) if most < 2**52 else q @ c.T


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(float) ** 2).sum(1))


def best(q_rows, q, c_rows, c_ids, c, floor, turn, k: int):
    """(query's place, candidate's place, score) of what may be among a query's k best of this block.

    q_rows and c_rows are the rows' numbers: a query meets every row but its own. floor: the score of a candidate that k candidates of the query are known to reach (or -inf).
    Candidates come by descending length, so those too short for every floor are a tail. After each step
    of rotated dimensions a pair's score is at most its partial sum plus the product of
    the lengths of the two remainders (Cauchy-Schwarz); pairs below the floor go, and only the
    others are summed up, in integers.
    """
    rq, rc = q @ turn, c @ turn
    # length of what is left of a vector from each dimension on
    left_q, left_c = (np.sqrt(np.cumsum((x**2)[:, ::-1], 1)[:, ::-1]) for x in (rq, rc))
    slack = 1e-6 * (1 + left_q[:, 0].max() * left_c[:, 0].max())
    out = [], [], []
    for at in range(0, len(q), 256):
        rows = np.arange(at, min(at + 256, len(q)))
        need = ((floor[rows] - slack) / np.maximum(left_q[rows, 0], 1e-9)).min()
        reach = int((left_c[:, 0] >= need).sum())
        i = j = part = None
        done = 0
        for step in [s for s in STEPS if s < q.shape[1]]:
            if i is None:
                part = rq[rows, :step] @ rc[:reach, :step].T
                keep = part + left_q[rows, step][:, None] * left_c[None, :reach, step] >= floor[rows][:, None] - slack
                if keep.mean() > 0.2:
                    continue  # too many are left for a list of pairs
                i, j = np.nonzero(keep)
                part, i = part[i, j], rows[i]
            else:
                part = part + np.einsum("nd,nd->n", rq[i, done:step], rc[j, done:step])
                keep = part + left_q[i, step] * left_c[j, step] >= floor[i] - slack
                i, j, part = i[keep], j[keep], part[keep]
            done = step
        if i is None:
            score = exact_products(q[rows], c[:reach])
            i, j = np.nonzero(score >= floor[rows][:, None])
            s, i = score[i, j], rows[i]
        else:
            s = np.concatenate([np.zeros(0, np.int64), *((q[i[a : a + 65536]] * c[j[a : a + 65536]]).sum(1) for a in range(0, len(i), 65536))])
        ok = (s >= floor[i]) & (q_rows[i] != c_rows[j])
        i, j, s = i[ok], j[ok], s[ok]
        order = np.lexsort((c_rows[j], c_ids[j], -s, i))
        i, j, s = i[order], j[order], s[order]
        top = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
        for to, x in zip(out, (i[top], j[top], s[top])):
            to.append(x)
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in out)


def _blocks(rows: DataFrame, size: int, width: int) -> DataFrame:
    """Rows packed by descending length: bid, norm (the longest), rows, ids and data (int64 bytes)."""

    def packed(t):
        norm = float(np.sqrt(t["norm2"].to_numpy().max()))
        parts = [x.astype("<i8").tobytes() for x in (t["row"].to_numpy(), t["id"].to_numpy(), padded(t["v"], width))]
        return pa.RecordBatch.from_arrays([pa.array([norm]), *(pa.array([x], pa.binary()) for x in parts)], names=["norm", "rows", "ids", "data"])

    def cut(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows >= size:
                yield packed(held.slice(0, size))
                held = held.slice(size)
        if held is not None and held.num_rows:
            yield packed(held)

    dealt = rows.repartitionByRange(F.desc("norm2"), "id", "row").sortWithinPartitions(F.desc("norm2"), "id", "row")
    return written(dealt.mapInArrow(cut, "norm double, rows binary, ids binary, data binary").withColumn("bid", F.monotonically_increasing_id()))


def topk(vectors: DataFrame, queries, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query with all other rows.

    Components are floor(scale * x). `queries` makes a condition of the id column. Ties go to the smaller id; a query
    with fewer candidates gets them all. See `scaled` for rows that take no part; shorter vectors count as if
    filled with zeros. Rows that repeat an id, with the same vector or not, are each a query of its own and a candidate of every
    other row. An empty table gives no rows; other columns, of any name, are not read.

    Rows are packed into blocks by descending length. Every query first meets the SEEDS longest rows and as
    many by a hash, for a floor; then each block of queries meets, in a task of its own, each block of
    candidates that is long enough for some floor of its queries. Which blocks meet is told by their numbers, lengths and needs;
    vectors travel only to pairs that do.
    """
    rows = written(scaled(vectors, id_col, vector_col, scale))
    width = rows.agg(F.max("size")).first()[0] or 1
    turn = rotation(rows, width)
    blocks = _blocks(rows, BLOCK, width)
    asked = _blocks(rows.where(queries(F.col("id"))), QUERIES, width)
    count = blocks.count()
    # 2 * SEEDS rows at most
    first = rows.orderBy(F.desc("norm2"), "id", "row").limit(SEEDS).unionByName(rows.orderBy(F.xxhash64("id", "row"), "row").limit(SEEDS))
    first = {r["row"]: r["v"] for r in first.select("row", "v").collect()}
    seed_rows, seeds = np.array(list(first), np.int64), np.array([v + [0] * (width - len(v)) for v in first.values()], np.int64).reshape(len(first), width)
    known = vectors.sparkSession.sparkContext.broadcast((turn, seed_rows, seeds))

    def matrix(data: bytes) -> np.ndarray:
        return np.frombuffer(data, "<i8").reshape(-1, width)

    def floors(batches):
        _, seed_rows, seeds = known.value
        kinds = pa.schema([("qid", pa.int64()), ("q_rows", pa.binary()), ("q_ids", pa.binary()), ("q_data", pa.binary()), ("floor", pa.binary()), ("need", pa.float64())])
        for b in batches:
            out = []
            for r in b.to_pylist():
                q = matrix(r["data"])
                score = exact_products(q, seeds).astype(float)
                score[np.frombuffer(r["rows"], "<i8")[:, None] == seed_rows[None, :]] = -np.inf
                floor = np.partition(score, -k, 1)[:, -k] if score.shape[1] >= k else np.full(len(q), -np.inf)
                need = float((floor / np.maximum(lengths(q), 1e-9)).min())
                out.append({"qid": r["bid"], "q_rows": r["rows"], "q_ids": r["ids"], "q_data": r["data"], "floor": floor.tobytes(), "need": need})
            yield pa.RecordBatch.from_pylist(out, kinds)

    def meet(batches):
        turn = known.value[0]
        for b in batches:
            for r in b.to_pylist():
                q_rows, q_ids, c_rows, c_ids = (np.frombuffer(r[x], "<i8") for x in ("q_rows", "q_ids", "rows", "ids"))
                i, j, s = best(q_rows, matrix(r["q_data"]), c_rows, c_ids, matrix(r["data"]), np.frombuffer(r["floor"]), turn, k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q_rows[i], q_ids[i], c_rows[j], c_ids[j], s)], names=["query", "query_id", "row", "vec_id", "score"])

    kinds = "qid long, q_rows binary, q_ids binary, q_data binary, floor binary, need double"
    floored = written(asked.select("bid", "rows", "ids", "data").mapInArrow(floors, kinds))
    number = F.row_number().over(W.orderBy(F.desc("norm"), "bid")) - 1
    numbered = blocks.select("bid", "norm").withColumn("block", number)
    due = floored.select("qid", "need", F.explode(F.sequence(F.lit(0), F.lit(max(count, 1) - 1))).alias("block"))
    due = due.join(numbered, "block").where("norm >= need - 1e-6 * (1 + abs(need))").select("qid", "bid")
    pairs = due.join(floored.drop("need"), "qid").join(blocks.drop("norm"), "bid").repartition(F.xxhash64("bid", "qid"))
    found = pairs.drop("qid", "bid").mapInArrow(meet, "query long, query_id long, row long, vec_id long, score long")
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH fit AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.r AS query, q.vec_id AS query_id, c.r, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM fit q JOIN fit c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id, r)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
