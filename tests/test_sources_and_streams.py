"""File sources, sinks, and streams held against their batch equivalents."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import claims
from tessera.sources import files, sinks
from tessera.streaming import calls


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_json_sources(spark, tmp_path):
    golden = put(tmp_path / "g.jsonl", '{"query": "q1", "relevant_clause_ids": ["a", "b"]}\n\n{"query": "q2", "relevant_clause_ids": [], "lang": "en"}\n')
    assert [(r.query, r.lang) for r in files.golden(spark, golden).orderBy("query").collect()] == [("q1", "de"), ("q2", "en")]
    (tmp_path / "crm").mkdir()
    put(tmp_path / "crm" / "max.json", json.dumps({"caller_id": "1", "policyholder": {"name": "Max M"}, "policy": {"policy_number": "P1", "product": "motor"}}))
    put(tmp_path / "crm" / "fleet.json", json.dumps({"policyholder": {"contact_person": "Tom"}, "vehicles": [1, 2]}))
    got = {r.name: (r.holder, r.policy_number) for r in files.profiles(spark, str(tmp_path / "crm")).collect()}
    assert got == {"max": ("Max M", "P1"), "fleet": ("Tom", None)}
    (tmp_path / "dom").mkdir()
    put(tmp_path / "dom" / "d.json", json.dumps({"id": "fnol", "name": "N", "targets": [{"id": "t1", "descriptor": "x"}, {"id": "t2", "descriptor": "y"}]}, indent=1))
    assert [(r.seq, r.target) for r in files.domain_targets(files.domains(spark, str(tmp_path / "dom"))).orderBy("seq").collect()] == [(0, "t1"), (1, "t2")]
    (tmp_path / "sc").mkdir()
    put(tmp_path / "sc" / "s.json", json.dumps({"name": "s", "crm_profile": "max", "caller_turns": ["a", "b"]}))
    s = files.scenarios(spark, str(tmp_path / "sc"))
    assert s.first().domain == "insurance_fnol" and files.scenario_turns(s).count() == 2
    clips = put(tmp_path / "m.json", json.dumps({"categories": {"ack": [{"id": "a1", "text": "ok"}], "wait": [{"id": "w1", "text": "hm"}, {"id": "w2", "text": "so"}]}}))
    assert files.clips(spark, clips).count() == 3


def test_prompts_and_baseline(spark, tmp_path):
    put(tmp_path / "p.v1.yaml", "name: p\nversion: '1'\nactive: true\ntemplate: |\n  Hello {x}\n  there\n")
    put(tmp_path / "p.v2.yaml", "name: p\nversion: 2\nactive: false\ntemplate: one line\n")
    got = {r.version: (r.template, r.active) for r in files.prompts(spark, str(tmp_path), "p").collect()}
    assert got == {"1": ("Hello {x}\nthere\n", True), "2": ("one line", False)}
    new, old = put(tmp_path / "b.json", '{"metrics": {"mrr": 0.5}, "provenance": {"eval_k": 5}}'), put(tmp_path / "o.json", '{"mrr": 0.4}')
    m, p = files.baseline(spark, new)
    assert [tuple(r) for r in m.collect()] == [("mrr", 0.5)] and [tuple(r) for r in p.collect()] == [("eval_k", "5")]
    m, p = files.baseline(spark, old)
    assert [tuple(r) for r in m.collect()] == [("mrr", 0.4)] and p.collect() == []
    rows = put(tmp_path / "t.jsonl", "\n".join(['{"tokenized_text": ["a"], "ner": []}'] * 4))
    with pytest.raises(ValueError):
        files.training_rows(spark, rows)
    assert files.newest_file(spark, str(tmp_path), "*.jsonl").endswith("t.jsonl")


def test_sinks(spark, tmp_path):
    p = str(tmp_path)
    cache = lambda *keys: spark.createDataFrame([(k, [1.0]) for k in keys], "key string, vector array<float>")
    sinks.put_cache(cache("a", "b", "b"), f"{p}/cache")
    sinks.put_cache(cache("b", "c"), f"{p}/cache")
    assert sorted(r.key for r in spark.read.parquet(f"{p}/cache").collect()) == ["a", "b", "c"]
    t = spark.createDataFrame([("1", "mail max@email.de, policy DE-HUK-2024-884421")], "trace_id string, response string")
    sinks.write_traces(t, f"{p}/traces", batch=0)
    sinks.write_traces(t, f"{p}/traces", batch=0)
    assert [r.response for r in spark.read.parquet(f"{p}/traces").collect()] == ["mail [EMAIL], policy [POLICY]"]
    v = spark.createDataFrame([("c", "x" * 300, 0.987654, ["l"])], "call_id string, reasoning string, confidence double, transcript array<string>")
    sinks.write_verdicts(v, f"{p}/verdicts")
    row = spark.read.option("header", True).csv(f"{p}/verdicts/csv").first()
    assert len(row.reasoning) == 200 and row.confidence == "0.99"
    sinks.write_manifest(spark.createDataFrame([("d", "c1"), ("d", "c2")], "doc_id string, id string"), f"{p}/manifest", {"emb_v1": 1024})
    assert spark.read.json(f"{p}/manifest").first().n_chunks == 2
    m, q = spark.createDataFrame([("mrr", 0.5)], "metric string, value double"), spark.createDataFrame([("k", "5")], "key string, value string")
    with pytest.raises(ValueError):
        sinks.write_baseline(m, q, f"{p}/base", ["groundedness"], strict=True)
    sinks.write_baseline(m, q, f"{p}/base", [])
    assert files.baseline(spark, f"{p}/base")[0].first().value == 0.5
    assert [r.key for r in sinks.not_made_yet(cache("a", "z"), cache("a"), "key").collect()] == ["z"]


def replay(spark, tmp_path, rows, ddl, flow, name):
    """Rows through a stream, two files one after the other; all that came out."""
    source = str(tmp_path / f"{name}-in")
    half = len(rows) // 2
    for part in (rows[:half], rows[half:]):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(source)
    out = []
    query = calls.to_all(flow(stream), [lambda batch, n: out.extend(batch.collect())], str(tmp_path / f"{name}-cp"))
    query.awaitTermination()
    return out


def test_rolling_claims_stream_equals_batch(spark, tmp_path):
    lines = ["My car crashed on the A4 near Berlin yesterday at", "14:30 and the police came, case number 7742", "I have whiplash and it was 3 weeks ago you know", "so it is not drivable any more, please help me now"]
    rows = [(c, i, f"{line} {c}") for i, line in enumerate(lines * 2) for c in (1, 2)]
    ddl = "call_id long, seq long, text string"
    chunks = replay(spark, tmp_path, rows, ddl, calls.rolling_chunks, "chunks")
    for c in (1, 2):
        held, want = [], []
        for _, i, text in sorted(r for r in rows if r[0] == c):
            held += text.split()
            if len(held) >= 20:
                held = held[-40:]
                want.append((i, " ".join(held)))
        assert sorted((r.seq, r.chunk) for r in chunks if r.call_id == c) == want
    spans = calls.extractions(spark.createDataFrame(chunks))
    states = replay(spark, tmp_path, sorted((r.call_id, r.seq, r.chunk) for r in chunks), "call_id long, seq long, chunk string", lambda s: calls.claim_states(calls.extractions(s)), "states")
    last = {r.call_id: json.loads(r.pillars) for r in sorted(states, key=lambda r: r.seq)}
    want = {}
    for r in calls.final_states(spans).collect():
        want.setdefault(r.call_id, {})[r.label] = [r.value, r.score]
    assert last == want and json.loads(states[-1].fraud).get("delayed_reporting") == "3 weeks ago"


def test_dashboard_stream_equals_batch(spark, tmp_path):
    kinds = ["entity", "call_start", "entity", "fraud_signal", "tool_call", "emotional_state", "transcript", "tool_result", "call_end", None]
    rows = [(i % 3, i, kinds[(i * 7) % 10], f"n{i % 4}", str(i)) for i in range(120)]
    ddl = "call_id long, seq long, type string, name string, value string"
    out = replay(spark, tmp_path, rows, ddl, calls.dashboard, "views")
    last = {r.call_id: json.loads(r.view) for r in sorted(out, key=lambda r: r.seq)}
    for r in claims.reduced(spark.createDataFrame(rows, ddl)).collect():
        v = last[r.call_id]
        assert (v["mode"], v["active"], v["lines"], v["tools"], v["pillars"], v["fraud"]) == (r["mode"], r.active, r.n_lines, r.tools or [], r.pillars or {}, r.fraud or {})


def test_utterances_stream_equals_batch(spark, tmp_path):
    rows = [(1, float(t), i, f"w{i}") for i, t in enumerate([0, 1, 2.5, 7, 8, 20, 21])] + [(1, 100000.0, 99, "end")]
    pieces = lambda df: calls.utterances(calls.timed(df.withColumn("ts", F.timestamp_seconds("at")), late="1 minute"))
    ddl = "call_id long, at double, seq long, text string"
    want = {r.text for r in pieces(spark.createDataFrame(rows, ddl)).collect()}
    assert want == {"w0 w1 w2", "w3 w4", "w5 w6", "end"}
    assert {r.text for r in replay(spark, tmp_path, rows, ddl, pieces, "said")} == want - {"end"}
