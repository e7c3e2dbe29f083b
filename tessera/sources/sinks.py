"""Writers: points by version, vector cache, traces, manifests, transcripts and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import rules
from tessera.operators.monitoring import upserted


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def upsert_points(points: DataFrame, path: str) -> None:
    """Points (id, version, vector) merged by id into a table partitioned by version.

    Only the versions that the points have are rewritten, each into a new folder that then takes
    the old one's place, so that readers of other versions are not disturbed.
    """
    spark = points.sparkSession
    if _exists(spark, path):
        old = spark.read.schema(points.schema).parquet(path).join(points.select("version").distinct(), "version", "left_semi").select(*points.columns)
        points = upserted(old, points, ["id", "version"]).checkpoint()
    points.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def put_cache(rows: DataFrame, path: str) -> None:
    """Appends the vectors (key, vector) whose key the cache has not."""
    spark = rows.sparkSession
    fresh = rows.dropDuplicates(["key"]).join(read_or_empty(spark, path, rows.schema).select("key"), "key", "left_anti")
    fresh.write.mode("append").parquet(path)


def write_traces(traces: DataFrame, path: str, batch: int | None = None) -> None:
    """Appends traces with their responses redacted; of a batch that is written again the first stays."""
    safe = traces.withColumn("response", rules.redact(F.col("response")))
    if batch is None:
        safe.write.mode("append").parquet(path)
    else:
        safe.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def write_manifest(chunks: DataFrame, path: str, versions: dict, dry_run: bool = False) -> None:
    """One JSON row of what was indexed."""
    one = chunks.agg(F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n_chunks"))
    one = one.withColumn("versions", F.create_map(*[F.lit(x) for kv in versions.items() for x in kv])).withColumn("dry_run", F.lit(dry_run)).withColumn("created", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))
    one.coalesce(1).write.mode("overwrite").json(path)


def write_calls(calls: DataFrame, path: str, key: str = "call_id") -> None:
    """Transcripts or claim states as JSON, a folder a call."""
    calls.write.mode("overwrite").partitionBy(key).json(path)


def write_verdicts(rows: DataFrame, path: str) -> None:
    """Verdicts as JSON, and as CSV with reasons cut to 200 characters and confidence to two places."""
    rows.write.mode("overwrite").json(f"{path}/json")
    cut = rows.withColumn("reasoning", F.substring("reasoning", 1, 200)).withColumn("confidence", F.format_string("%.2f", "confidence"))
    cut.select(*[c for c, t in cut.dtypes if not t.startswith(("array", "map", "struct"))]).write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def not_made_yet(wanted: DataFrame, made: DataFrame, key: str) -> DataFrame:
    """What of `wanted` has still to be made."""
    return wanted.join(made.select(key), key, "left_anti")


def write_baseline(metrics: DataFrame, provenance: DataFrame, path: str, skipped: list[str], strict: bool = False) -> None:
    """Metrics and provenance as one JSON row; refused if strict and something was not measured."""
    if strict and skipped:
        raise ValueError(f"not measured: {', '.join(skipped)}")
    as_map = lambda df, k: df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, "value")))))
    one = as_map(metrics, "metric").toDF("metrics").crossJoin(F.broadcast(as_map(provenance, "key").toDF("provenance")))
    one.coalesce(1).write.mode("overwrite").json(path)


def write_records(rows: DataFrame, path: str, mode: str = "error") -> None:
    """Synthetic rows or benchmark results as JSON lines; an existing path is kept unless mode says otherwise."""
    rows.write.mode(mode).json(path)


def publish(url: str, timeout: float = 2.0):
    """A function for foreachBatch that posts each row as JSON and forgets it: what can't be delivered in `timeout` seconds is lost, and no error stops the stream.

    Rows go out where they are, from the executors.
    """

    def post(rows) -> None:
        from urllib.request import Request, urlopen

        for r in rows:
            try:
                urlopen(Request(url, r["value"].encode(), {"Content-Type": "application/json"}), timeout=timeout).close()
            except (OSError, ValueError):
                continue

    def batch(rows: DataFrame, _: int) -> None:
        rows.select(F.to_json(F.struct("*")).alias("value")).foreachPartition(post)

    return batch
