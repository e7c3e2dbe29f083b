"""Deterministic hash vectors, the vector cache and index versions."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import fixed, text

from . import monitoring


def hash_vector(version: str, dim: int, value: str) -> np.ndarray:
    """A unit vector drawn from a seed that follows from version and text: no meaning, but the same everywhere."""
    digest = hashlib.sha256(f"{version}\0{value}".encode()).digest()
    drawn = np.random.default_rng(int.from_bytes(digest[:8], "big")).standard_normal(dim).astype(np.float32)
    size = np.linalg.norm(drawn)
    return drawn / size if size else drawn


def hash_embedder(version: str):
    dim = fixed.EMBEDDING_VERSIONS[version][1]

    @F.arrow_udf("array<float>")
    def embed(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else hash_vector(version, dim, t) for t in texts.to_pylist()], pa.list_(pa.float32()))

    return embed


def embedded(chunks: DataFrame, version: str, embedder=None, cache: DataFrame | None = None) -> DataFrame:
    """id, version and vector of chunks (id, text): cached vectors by content hash, the others embedded once a text.

    Hash vectors are never cached, since their keys are those of the real model.
    """
    model = fixed.EMBEDDING_VERSIONS[version][0]
    embedder = embedder or hash_embedder(version)
    rows = chunks.select("id", "text", text.content_hash(F.lit(model), F.col("text")).alias("key"))
    if cache is None:
        return rows.select("id", F.lit(version).alias("version"), embedder("text").alias("vector"))
    fresh = rows.select("key", "text").join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])
    known = cache.select("key", "vector").unionByName(fresh.select("key", embedder("text").alias("vector")))
    return rows.join(known, "key").select("id", F.lit(version).alias("version"), "vector")


class Index:
    """Vectors of several versions, of which one is active; a migration fills, compares, and then switches.

    Tables live under `path`: points by version, and one row of meta.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def points(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/points")

    def meta(self):
        return self.spark.read.json(f"{self.path}/meta").orderBy(F.desc("seq")).first()

    def _put(self, active: str, slots: list[str], seq: int) -> None:
        """Adds a state: the newest stands, so that a reader finds the one before until the write is done."""
        rows = self.spark.createDataFrame([(seq, active, sorted(set(slots)))], "seq long, active string, slots array<string>")
        rows.coalesce(1).write.mode("append").json(f"{self.path}/meta")

    def create(self, active: str = "emb_v1") -> None:
        self._put(active, list(fixed.EMBEDDING_VERSIONS), 0)

    def introduce(self, version: str) -> None:
        if version not in self.meta()["slots"]:
            raise LookupError(f"the index has no slot for {version}; create it anew with the version registered")

    def status(self, chunks: DataFrame) -> DataFrame:
        """version, covered, total and active."""
        return monitoring.coverage(chunks, self.points()).withColumn("active", F.col("version") == self.meta()["active"])

    def backfill(self, chunks: DataFrame, version: str, embedder=None) -> int:
        """Embeds what has no vector of the version yet; safe to run again after a stop. Returns how many."""
        from tessera.sources.sinks import upsert_points

        self.introduce(version)
        due = monitoring.missing(chunks, self.points(), version)
        n = due.count()
        if n:
            upsert_points(embedded(due, version, embedder), f"{self.path}/points")
        return n

    def cutover(self, chunks: DataFrame, version: str, force: bool = False) -> None:
        """Makes a version active; refused while vectors are missing, unless forced."""
        left = monitoring.missing(chunks, self.points(), version).count()
        if left and not force:
            raise ValueError(f"{left} chunks have no vector of {version}")
        self._activate(version)

    def rollback(self, version: str) -> None:
        """Makes an earlier version active again, without looking at coverage."""
        self._activate(version)

    def _activate(self, version: str) -> None:
        self.introduce(version)  # an error for a version that the index doesn't know
        now = self.meta()
        self._put(version, now["slots"], now["seq"] + 1)

    def active_view(self, name: str) -> None:
        """A view of the active version's points, replaced in one step."""
        self.points().where(F.col("version") == self.meta()["active"]).createOrReplaceTempView(name)
