"""Extraction, intents, claim state, drift and gate on hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import fixed, rules
from tessera.operators import claims, monitoring

AUTO = "I crashed on the A4 today at 14:30, I have whiplash. The other plate was K-AB 1234. My car is not drivable. Police came, case number is 2026-04."


def turns(spark, *texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "call_id int, turn int, text string")


def test_extraction_of_a_crash(spark):
    got = {r.label: (r.value, r.score) for r in rules.extract(turns(spark, AUTO), ["call_id", "turn"]).collect()}
    assert got["claim_type"] == ("auto", 0.65) and got["incident_datetime"] == ("today", 0.72) and got["incident_location"] == ("A4", 0.75)
    assert got["injuries_or_symptoms"] == ("whiplash", 0.78) and got["other_party_plate"] == ("K-AB 1234", 0.85) and got["vehicle_drivable"] == ("no", 0.80)
    assert got["police_or_ambulance"] == ("police", 0.78) and got["police_case_number"] == ("number", 0.82)
    ties = {r.label: r.value for r in rules.extract(turns(spark, "at the Medical Center, then a hospital in Berlin"), ["call_id", "turn"]).collect()}
    assert ties["incident_location"] == "Medical Center" and ties["claim_type"] == "health"
    assert rules.extract(turns(spark, None, ""), ["call_id", "turn"]).collect() == []


def test_merge_is_strict(spark):
    ddl = "call_id int, kind string, label string, value string, score double"
    base = spark.createDataFrame([(1, "pillar", "a", "old", 0.5), (1, "pillar", "b", "old", 0.5)], ddl)
    over = spark.createDataFrame([(1, "pillar", "a", "new", 0.5), (1, "pillar", "b", "new", 0.6), (1, "pillar", "c", "new", 0.1)], ddl)
    assert {r.label: r.value for r in rules.merged(base, over, ["call_id"]).collect()} == {"a": "old", "b": "new", "c": "new"}


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ("Are you okay? Anyone hurt?", ["injuries"]),
        ("Is the car drivable?", ["vehicle_drivable"]),
        ("Were the police called? Got a case number?", ["police_case_number", "police_involved"]),
        ("Just so I have it noted.", []),
        ("", []),
    ],
)
def test_intents(spark, reply, want):
    assert turns(spark, reply).select(rules.intents(F.col("text"))).first()[0] == want


def test_modes_and_places(spark):
    t = turns(spark, "I'm scared, there is traffic", "loud static", "fine", "We were on the A4, near Köln. Nothing else", None)
    rows = t.select(rules.emotion(F.col("text")).alias("e"), rules.mode(F.col("text"), F.lit("noisy")).alias("m"), rules.place(F.col("text")).alias("p"), rules.lookups(F.col("text")).alias("l")).collect()
    assert [r.e for r in rows] == ["distressed", "noisy", "calm", "calm", "calm"]
    assert [r.m for r in rows] == ["distressed", "noisy", "noisy", "noisy", "noisy"]
    assert rows[3].p == "We were on the A4" and rows[2].p is None and rows[3].l == ["weather"]


def test_fill_keeps_the_first_of_the_highest(spark):
    s = spark.createDataFrame([(1, t, "pillar", "x", v, c) for t, v, c in ((0, "a", 0.7), (1, "b", 0.7), (2, "c", 0.9))], "call_id int, turn int, kind string, label string, value string, score double")
    assert claims.filled(s).first().value == "c" and claims.filled(s.where("turn < 2")).first().value == "a"


def test_fraud(spark):
    f = spark.createDataFrame(
        [(1, 0, "a", "e0", "high"), (1, 1, "a", "e1", "odd"), (2, 0, "a", "", "high"), (2, 0, "b", "", "high"), (2, 0, "c", "", "high"), (3, 0, "a", "", "medium"), (3, 0, "b", "", "medium")],
        "call_id int, turn int, signal string, evidence string, severity string",
    )
    last = claims.flagged(f)
    assert last.where("call_id = 1").first().evidence == "e1"
    assert {r.call_id: (r.score, r.gauge, r.band) for r in claims.risk(last).collect()} == {1: (1, 1.0, "low"), 2: (10, 10.0, "high"), 3: (4, 5.0, "moderate")}


def test_targets_and_progress(spark):
    calls = spark.createDataFrame([(1,), (2,)], "call_id int")
    pillars = spark.createDataFrame([(2, p, "auto car") for p, _ in fixed.PILLARS], "call_id int, label string, value string")
    asked = spark.createDataFrame([(1, "vehicle_drivable"), (1, "injuries_or_symptoms"), (1, "weather")], "call_id int, label string")
    got = {r.call_id: r for r in claims.targets(calls, pillars, asked).collect()}
    assert got[1].phase == "greeting" and len(got[1].open) == 11 and got[1].parked == ["injuries_or_symptoms", "vehicle_drivable"] and got[1].text.endswith(" and 7 more")
    assert got[2].phase == "wrap_up" and got[2].open == [] and got[2].text == "all captured"
    p = claims.progress(pillars).first()
    assert (p.claim_type, p.n_filled, p.n_applicable, p.share) == ("auto", 11, 11, 1.0)


def test_speaker_runs_and_turns(spark):
    t = spark.createDataFrame([(1, 1, "A", "x"), (1, 2, "A", "y"), (1, 3, "B", "z"), (1, 4, "A", "w")], "call_id int, turn int, role string, text string")
    got = claims.speaker_runs(t).orderBy("run").collect()
    assert [(r.role, r.text, r.turn) for r in got] == [("A", "x y", 2), ("B", "z", 3), ("A", "w", 4)]
    u = claims.user_turns(t, user="A", agent="B", wrap=3).orderBy("turn").collect()
    assert [(r.user_turn, r.last_agent, r.wrap_up) for r in u] == [(1, None, False), (2, None, False), (3, "z", True)]
    words = spark.createDataFrame([(1, i, " ".join(f"w{i}_{k}" for k in range(9))) for i in range(6)], "call_id int, turn int, text string")
    assert claims.rolling_chunk(words).first().chunk.split()[0] == "w1_5"


def test_labels(spark):
    rows = spark.createDataFrame([("accident_date",), ("pain",), ("own",)], "label string")
    assert [r[0] for r in rows.select(claims.aliased(F.col("label"))).collect()] == ["incident_datetime", "pain", "own"]
    assert [r.label for r in claims.known(rows).collect()] == ["injuries_or_symptoms"]
    f = spark.createDataFrame([(["a", "b"], ["a"]), (["a"], []), (["a"], ["b"]), ([], ["b"])], "predicted array<string>, gold array<string>")
    assert [round(r[0], 4) for r in f.select(claims.label_f1(f)).collect()] == [0.6667, 1.0, 0.0, 0.0]


def trace(spark, grounded, scores=None):
    rows = [(i, float(i), g, s) for i, (g, s) in enumerate(zip(grounded, scores or grounded))]
    return spark.createDataFrame(rows, "id int, ts double, groundedness double, top_score double")


def drift(spark, grounded, scores=None, window=20):
    return {r.metric: r for r in monitoring.drift(trace(spark, grounded, scores), window, F.desc("ts")).collect()}


def test_drift(spark):
    assert drift(spark, [0.9] * 10) == {}
    fell = drift(spark, [0.97] * 20 + [0.55] * 20)["groundedness_rate"]
    assert fell.drift and fell.delta < 0
    assert not any(r.drift for r in drift(spark, [0.97] * 40).values())
    empty = drift(spark, [None] * 40)
    assert empty["groundedness_rate"].recent == 0.0 and empty["retrieval_score_psi"].delta == 0.0
    moved = drift(spark, [0.97] * 40, [i / 100 for i in range(10, 30)] + [0.9] * 20)["retrieval_score_psi"]
    assert moved.drift and abs(moved.delta - 12.433960) < 1e-5
    assert abs(drift(spark, [0.97] * 40, [float(i) for i in range(20)] + [float(i) for i in range(10, 20)] * 2)["retrieval_score_psi"].delta - 6.103039) < 1e-5
    assert drift(spark, [0.97] * 40, [0.5] * 40)["retrieval_score_psi"].delta == 0.0


def test_gate(spark):
    m = lambda **v: spark.createDataFrame([(k.replace("_at_", "@"), x) for k, x in v.items()], "metric string, value double")
    fails = lambda now, was, strict=False: [(r.metric, r.reason) for r in monitoring.regressions(now, was, strict).collect()]
    assert fails(m(ndcg_at_5=0.70), m(ndcg_at_5=0.80)) == [("ndcg@5", "drop")]
    assert fails(m(ndcg_at_5=0.795), m(ndcg_at_5=0.80)) == [] and fails(m(ndcg_at_5=0.95), m(ndcg_at_5=0.80)) == []
    none = m(other=1.0)
    assert fails(none, m(groundedness=0.9)) == [] and fails(none, m(groundedness=0.9), True) == [("groundedness", "not measured")]
    changes = spark.createDataFrame([("judge_model", "a", "b")], "key string, now string, was string")
    assert monitoring.comparable(m(groundedness=0.9, mrr=0.1), changes).count() == 1


def test_prompts(spark):
    p = spark.createDataFrame([("a", "1", "t1", True), ("a", "2", "t2", False), ("b", "1", "t", True), ("b", "2", "t", True)], "name string, version string, template string, active boolean")
    assert monitoring.active_prompt(p, "a").version == "1" and monitoring.active_prompt(p, "a", "2").content_hash != monitoring.active_prompt(p, "a").content_hash
    assert len(monitoring.active_prompt(p, "a").content_hash) == 12
    for name, version in (("b", None), ("a", "9"), ("c", None)):
        with pytest.raises(LookupError):
            monitoring.active_prompt(p, name, version)


def test_families(spark):
    rows = spark.createDataFrame([("gemini", None), ("ollama", None), ("ollama", "gemma2:9b"), ("ollama", "llama3.2:3b"), ("ollama", "phi"), ("openai", "x")], "b string, m string")
    assert [r[0] for r in rows.select(monitoring.family(F.col("b"), F.col("m"))).collect()] == ["google", "local-oss", "google", "meta", "local-oss", "openai"]


def test_reducer_starts_anew(spark):
    e = spark.createDataFrame(
        [(1, 1, "entity", "a", "x"), (1, 2, "call_start", "", ""), (1, 3, "entity", "a", "y"), (1, 4, "entity", "a", "z"), (1, 5, "tool_call", "t1", ""), (1, 6, "tool_result", "t2", ""), (1, 7, None, "q", "q"), (1, 8, "emotional_state", "", "noisy"), (2, 1, "call_end", "", "")],
        "call_id int, seq int, type string, name string, value string",
    )
    got = {r.call_id: r for r in claims.reduced(e).collect()}
    assert got[1].pillars == {"a": "z"} and got[1].tools == ["t2", "t1"] and got[1].mode == "noisy" and got[1].active
    assert got[2].mode == "calm" and not got[2].active and got[2].pillars is None
