"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .buckets import Forest, pieced, runs_of
from .common import written
from .components import connected_components

SEED = 11
#: Rows of a bucket before it is cut, rows of a tile of products.
BUCKET, TILE = 4096, 512
#: Chance, with probes, that one function keeps a pair at the threshold together, and of missing it in all tables.
KEPT, MISSED = 0.75, 0.002


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows (a power of two long)."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, width)
        step *= 2
    return x


def codes(x: np.ndarray, tables: int, functions: int, probes: int) -> np.ndarray:
    """(rows, tables, 1 + probes) bucket codes of unit rows.

    Each function turns a row by three rounds of random signs and Hadamard transforms and names
    the nearest corner of the cross-polytope. A table's home bucket joins its functions' corners; its probes change
    one function's corner to the next nearest, those that give up least first.
    """
    width = 1 << max(1, int(np.ceil(np.log2(max(2, x.shape[1])))))
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    rng = np.random.default_rng([SEED, width])
    out = np.zeros((len(x), tables, 1 + probes), np.int64)
    row = np.arange(len(x))
    for t in range(tables):
        first, second, loss = [], [], []
        for _ in range(functions):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width)) / np.sqrt(width)
            size = np.abs(y)
            two = np.argpartition(-size, 1, 1)[:, :2] if width > 1 else np.zeros((len(x), 2), int)
            swap = size[row, two[:, 0]] < size[row, two[:, 1]]
            a, b = np.where(swap, two[:, 1], two[:, 0]), np.where(swap, two[:, 0], two[:, 1])
            first.append(2 * a + (y[row, a] < 0))
            second.append(2 * b + (y[row, b] < 0))
            loss.append(size[row, a] - size[row, b])
        radix = (2 * width) ** np.arange(functions, dtype=np.int64)
        home = (np.stack(first, 1) * radix).sum(1)
        moved = home[:, None] + (np.stack(second, 1) - np.stack(first, 1)) * radix
        order = np.argsort(np.stack(loss, 1), 1, "stable")
        out[:, t, 0] = home
        for p in range(probes):
            out[:, t, 1 + p] = moved[row, order[:, p]] if p < functions else home
    return out


def first_meeting(a: np.ndarray, b: np.ndarray, table: int, code: int) -> np.ndarray:
    """Whether rows of codes a and b share no bucket before bucket `code` of `table`."""
    same = a[:, : table + 1, :, None] == b[:, : table + 1, None, :]
    before = same[:, :table].any((1, 2, 3))
    here = (same[:, table] & (a[:, table, :, None] < code)).any((1, 2))
    return ~(before | here)


def link_bucket(x, mult, own, pair, code_of, table: int, code: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, label): the weight of partners of each row first met in this bucket, and joined labels.

    pair: the two pieces that meet, if the bucket is a meeting of pieces; then only rows of different pieces
    pair up, or all of one piece.
    """
    n, links, forest = len(x), np.zeros(len(x), np.int64), Forest(len(x))
    for at in range(0, n, TILE):
        near = x[at : at + TILE] @ x[at:].T >= threshold
        i, j = np.nonzero(near)
        i, j = i + at, j + at
        keep = i < j
        if pair is not None and pair[0] != pair[1]:
            keep &= own[i] != own[j]
        i, j = i[keep], j[keep]
        forest.join(i, j)
        for a in range(0, len(i), 1 << 16):
            k, m = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
            new = first_meeting(code_of[k], code_of[m], table, code)
            links += np.bincount(k[new], mult[m[new]], n).astype(np.int64) + np.bincount(m[new], mult[k[new]], n).astype(np.int64)
    return links, forest.label


def units(data, width: int, kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(data), kind).astype(np.float64).reshape(-1, width)
    return x / np.sqrt((x * x).sum(1))[:, None]


def links_of(classes: DataFrame, n: int, width: int, threshold: float, kind: str = "<f8", probes: int = 2) -> DataFrame:
    """(cid, links, a, b): link counts of classes first met in a bucket, and edges (a, b) that connect them.

    classes: cid, mult and v (bytes of `kind`, which holds each component exactly) of distinct vectors. Rows travel to every
    bucket with v and their codes, so both are as narrow as they can be. The number of functions of a table grows with the
    logarithm of n, so that buckets stay small, and the number of tables with what that costs in recall.
    """
    side = 2 << max(1, int(np.ceil(np.log2(max(2, width)))))
    functions = max(1, round(np.log(max(n, 2)) / np.log(side)))
    tables = int(np.ceil(np.log(MISSED) / np.log(1 - KEPT**functions)))
    corners = side**functions
    narrow = "<u2" if corners <= 1 << 16 else "<u4" if corners <= 1 << 32 else "<i8"
    kinds = "tbl int, code long, cid long, mult long, v binary, codes binary"

    def hash_rows(batches):
        for b in batches:
            if not b.num_rows:
                continue
            c = codes(units(b["v"].to_pylist(), width, kind), tables, functions, probes)
            fresh = np.ones(c.shape, bool)  # a table's codes once each
            for p in range(1, c.shape[2]):
                fresh[:, :, p] = (c[:, :, p, None] != c[:, :, :p]).all(2)
            row, table, probe = np.nonzero(fresh)
            packed = pa.array([x.tobytes() for x in c.astype(narrow)], pa.binary())
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(table.astype(np.int32)), pa.array(c[row, table, probe]), b["cid"].take(at), b["mult"].take(at), b["v"].take(at), packed.take(at)], names=["tbl", "code", "cid", "mult", "v", "codes"]
            )

    def link(keys):
        def run(batches):
            names = ["cid", "links", "a", "b"]
            for t in runs_of(batches, keys):
                key = [t[k].to_numpy() for k in keys]
                start = np.flatnonzero(np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in key])))
                out = []
                for s, e in zip(start, [*start[1:], t.num_rows]):
                    if e - s < 2:
                        continue
                    own = t.slice(s, e - s)
                    cid, mult = own["cid"].to_numpy(), own["mult"].to_numpy()
                    code_of = np.frombuffer(b"".join(own["codes"].to_pylist()), narrow).reshape(len(cid), tables, 1 + probes)
                    pair = (key[2][s], key[3][s]) if len(key) > 2 else None
                    links, label = link_bucket(units(own["v"].to_pylist(), width, kind), mult, own["own"].to_numpy() if pair else None, pair, code_of, int(key[0][s]), int(key[1][s]), threshold)
                    some = np.flatnonzero((links > 0) | (label != np.arange(len(label))))
                    out.append((cid[some], links[some], cid[some], cid[label[some]]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=names)

        return run

    keyed = written(classes.repartition(F.xxhash64("cid")).mapInArrow(hash_rows, kinds))
    found = []
    for rows, keys in pieced(keyed, ["tbl", "code"], "cid", BUCKET):
        found.append(rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(link(keys), "cid long, links long, a long, b long"))
    return written(reduce(DataFrame.unionByName, found))


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    Links are pairs of cosine >= threshold in double precision, looked for in shared buckets
    only, each found pair verified. Equal vectors are one class, always linked. n_links counts the
    other (id, vector) pairs linked; component_id is the smallest id that links reach. Vectors that are null, empty, zero, or hold null or
    non-finite components link with nothing, and with them rows of null id; shorter vectors count as if filled with zeros.
    Repeated rows each get a row, and count as one.
    """
    wide = F.col(vector_col).cast("array<double>")
    fit = F.col(id_col).isNotNull() & F.coalesce(~F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(wide, lambda x: x != 0), F.lit(False))
    all_rows = vectors.select(F.col(id_col).alias("vec_id"), F.when(fit, wide).alias("v"))
    # equal up to trailing zeros is equal; -0.0 is 0.0
    rows = written(all_rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("h", F.xxhash64("v")))
    has = rows.where("v IS NOT NULL")
    kind = "<f4" if vectors.schema[vector_col].dataType.elementType == FloatType() else "<f8"
    width = has.agg(F.max(F.size("v"))).first()[0]
    if not width:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    classes = has.select("vec_id", "h", "v").distinct().groupBy("h", "v").agg(F.count("*").alias("mult"), F.min("vec_id").alias("least"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()))

    def as_bytes(batches):
        for b in batches:
            out = [np.pad(np.array(v, kind), (0, width - len(v))).tobytes() for v in b["v"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["cid"], b["mult"], pa.array(out, pa.binary())], names=["cid", "mult", "v"])

    found = links_of(classes.select("cid", "mult", "v").mapInArrow(as_bytes, "cid long, mult long, v binary"), classes.count(), width, threshold, kind)
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select("a", "b"))
    at = classes.join(roots, classes.cid == roots.node, "left").select("cid", "h", "v", "mult", "least", F.coalesce("root", "cid").alias("root"))
    named = at.join(at.groupBy("root").agg(F.min("least").alias("component_id")), "root").join(links, "cid", "left")
    named = named.select("h", "v", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked = has.join(named, ["h", "v"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    apart = rows.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(apart)
