"""Buckets of rows of equal keys: runs in sorted batches, cuts of large ones, links within."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


class Forest:
    """Labels that join as pairs come in; np.minimum keeps the smallest index of a group."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        lab = self.label
        while True:
            x, y = lab[a], lab[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            low, high = np.minimum(x, y), np.maximum(x, y)
            np.minimum.at(lab, high, low)
            while True:
                up = lab[lab]
                if np.array_equal(up, lab):
                    break
                lab[:] = up


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys, out of batches sorted by them."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        last = {k: held[k][held.num_rows - 1].as_py() for k in keys}
        same = np.logical_and.reduce([held[k].to_numpy() == last[k] for k in keys])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield held.slice(0, cut)
            held = held.slice(cut).combine_chunks()
    if held is not None and held.num_rows:
        yield held


def pieced(keyed: DataFrame, keys: list[str], item: str, limit: int) -> list[tuple[DataFrame, list[str]]]:
    """keyed as one or two tables of buckets, each with the columns that tell its buckets apart.

    Buckets of more than `limit` rows are cut into pieces (column own) by a hash of `item`, and each two pieces i <= j make
    a bucket of their own, so that none has many more than twice `limit` rows and
    every two rows of an uncut bucket still meet: rows of one piece in i = j, others in i < j.
    """
    large = checkpointed(keyed.groupBy(*keys).count().where(F.col("count") > limit))
    if large.isEmpty():
        return [(keyed, keys)]
    pieces = F.ceil(F.col("count") / limit).cast("int")
    cut = keyed.join(large, keys).withColumn("_pieces", pieces).withColumn("own", F.pmod(F.xxhash64(item), "_pieces").cast("int"))
    met = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)))
    met = met.withColumn("i", F.least("own", "_other")).withColumn("j", F.greatest("own", "_other")).drop("count", "_pieces", "_other")
    return [(keyed.join(large, keys, "left_anti"), keys), (met, [*keys, "i", "j"])]
