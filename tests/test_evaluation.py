"""Judges, lookups, coverage, redacted rows, publishing and an entry without the optional subpackage."""

import json
import re
import shutil
import subprocess
import sys
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluation
from tessera.sources import sinks

ROOT = Path(__file__).resolve().parent.parent


def test_without_a_judge_there_is_no_score(spark):
    answers = spark.createDataFrame([(1, "a")], "id int, answer string")
    with pytest.raises(evaluation.JudgeUnavailable):
        evaluation.judged(answers)
    assert evaluation.judged(answers, lambda a: a.withColumn("groundedness", F.lit(1.0))).first().groundedness == 1.0


def test_replies_of_a_judge(spark):
    replies = ['{"groundedness": 0.5}', '```json\n{"faithfulness": 1, "answer_correctness": 0.25, "rationale": "r"}\n```', "no object", "{broken", None]
    got = [r.s for r in spark.createDataFrame([(r,) for r in replies], "raw string").select(evaluation.judge_scores(F.col("raw")).alias("s")).collect()]
    assert tuple(got[0]) == (0.5, 0.0, None, "") and tuple(got[1]) == (0.0, 1.0, 0.25, "r") and got[2:] == [None, None, None]
    none = spark.createDataFrame([], "groundedness double")
    assert evaluation.score_means(none, ["groundedness"]).first().mean == 0.0


def test_coverage_of_labels(spark):
    want = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c")], "case int, label string")
    found = spark.createDataFrame([(1, "b"), (1, "z"), (3, "c")], "case int, label string")
    got = {r.case: (r.expected, r.found, r.missing, r.pct) for r in evaluation.label_coverage(want, found, "case").collect()}
    assert got == {1: (2, 1, ["a"], 50.0), 2: (1, 0, ["c"], 0.0)}


def test_redacted_rows_keep_their_shape(spark):
    mail = "write to ann.lee@post.example.org now"
    row = (1, mail, {"a": mail, "n": 5, "deep": {"b": mail}}, [mail, "plain"], [{"c": mail}])
    df = spark.createDataFrame([row, (2, None, None, None, None)], "id int, t string, s struct<a:string,n:int,deep:struct<b:string>>, l array<string>, k array<struct<c:string>>")
    out = evaluation.redacted(df)
    got, empty = out.orderBy("id").collect()
    clean = got.t
    assert out.schema.simpleString() == df.schema.simpleString() and "ann.lee" not in clean
    assert (got.s.a, got.s.n, got.s.deep.b, got.l) == (clean, 5, clean, [clean, "plain"])
    assert got.k[0].c == mail  # objects in lists stay as they are
    assert list(empty)[1:] == [None] * 4


def test_limits_lookups_and_rotation(spark):
    assert (evaluation.limit_or(0, 6), evaluation.limit_or(None, 6), evaluation.limit_or(3, 6)) == (6, 6, 3)
    asked = spark.createDataFrame([(1, "weather", "Ulm")], "query_id int, name string, query string")
    got = evaluation.looked_up(asked).first()
    assert (got.summary, got.stub, got.error) == ("[stub] weather: Ulm", True, None)
    got = spark.range(1).select(evaluation.rotation(F.lit("b"), F.lit(None), F.lit("a"), F.lit("b"), F.lit("")).alias("m")).first().m
    assert got == ["b", "a"]


def test_publishing_swallows_errors(spark, tmp_path):
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(204)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    rows = spark.range(5).coalesce(1)
    sinks.publish(f"http://127.0.0.1:{server.server_port}/events")(rows, 0)
    server.shutdown()
    server.server_close()
    sinks.publish(f"http://127.0.0.1:{server.server_port}/events", timeout=0.2)(rows, 1)
    assert sorted(r["id"] for r in seen) == list(range(5))
    sinks.write_records(rows, f"{tmp_path}/records")
    assert spark.read.json(f"{tmp_path}/records").count() == 5


def test_the_entry_works_without_the_optional_subpackage(tmp_path):
    for name in ("tessera", "__spark_entry__.py", "corpus_pipeline.py"):
        of = ROOT / name
        (shutil.copytree if of.is_dir() else shutil.copy)(of, tmp_path / name)
    shutil.rmtree(tmp_path / "tessera" / "llm", ignore_errors=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(e.queries()), sorted(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert not re.search(r"'op\d+_|'pipeline'", said.stdout) and "retrieval_bm25_topk" in said.stdout
