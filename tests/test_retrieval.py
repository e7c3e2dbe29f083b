"""Recall, rerank, answers, metrics and index versions."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import embedding, monitoring, ranking, retrieval
from tessera.sources import sinks

CLAUSES = [
    ("c1", "KK:§ 4", "§ 4", "KK", "de", "Die Selbstbeteiligung in der Teilkasko beträgt 150 Euro."),
    ("c2", "KK:§ 6", "§ 6", "KK", "de", "Parkschäden an der Stoßstange sind in der Vollkasko gedeckt."),
    ("c3", "HP:§ 1", "§ 1", "HP", "de", "Gegenstand der Versicherung sind Schäden Dritter. Schäden am eigenen Auto nicht."),
    ("c4", "VVG:§ 2", "§ 2", None, "de", "Der Versicherer leistet nach dem Gesetz."),
    ("c5", "EN:§ 9", "§ 9", "EN", "en", "Parking damage to the bumper is covered."),
]


def chunks(spark):
    c = spark.createDataFrame(CLAUSES, "chunk_id string, clause_id string, section_path string, product_code string, lang string, text string")
    return c.withColumn("tokens", text.tokens(F.concat_ws(" ", "text", "section_path"))).withColumn("body_tokens", text.tokens(F.col("text")))


def ask(spark, *queries):
    return spark.createDataFrame([(i, q, p, x) for i, (q, p, x) in enumerate(queries)], "query_id int, query string, product_code string, lang string")


def brute_bm25(query_terms, docs):
    n, avg = len(docs), sum(len(d) for d in docs.values()) / len(docs)
    out = {}
    for k, d in docs.items():
        s = 0.0
        for t in query_terms:
            tf, df = d.count(t), sum(t in x for x in docs.values())
            if tf:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / avg))
        if s > 0:
            out[k] = s
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


def test_bm25_against_brute_force_and_filters(spark):
    c = chunks(spark)
    q = ask(spark, ("Schäden Schäden in der Vollkasko", None, None), ("Parkschäden Stoßstange gedeckt", "KK", "de"), ("Schäden", "XX", None), ("völlig fremd", None, None))
    got = {}
    for r in retrieval.bm25(c, q, same=["product_code", "lang"]).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    docs = {r.chunk_id: r.tokens for r in c.collect()}
    terms = q.select("query_id", text.tokens(F.col("query")).alias("t")).collect()
    want = brute_bm25(terms[0].t, docs)
    assert [k for k, _ in got[0]] == [k for k, _ in want] and all(abs(a[1] - b[1]) < 1e-9 for a, b in zip(got[0], want))
    assert [k for k, _ in got[1]] == ["c2"] and set(got) == {0, 1}


def test_rerank_and_answers(spark):
    c = chunks(spark)
    q = ask(spark, ("Sind Parkschäden an der Stoßstange gedeckt?", None, None), ("Wie spät ist es in Tokio?", None, None))
    ranked = retrieval.lexical_rerank(retrieval.bm25(c, q), c, q)
    assert ranked.where("query_id = 0 AND rank = 1").first().chunk_id == "c2" and ranked.where("rank = 1").first().score == 1.0
    a = {r.query_id: r for r in retrieval.answers(q, ranked, c).collect()}
    assert not a[0].stub and a[0].summary.startswith("Laut KK:§ 6 (§ 6): ") and a[0].citations[0].clause_id == "KK:§ 6"
    assert a[1].stub and a[1].low_confidence and a[1].citations == []


@pytest.mark.parametrize("most", [20_000, 1])
def test_dense_top(spark, monkeypatch, most):
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", most)
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 1)
    v = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(12)], "chunk_id int, vector array<float>")
    q = v.where("chunk_id % 6 = 0").toDF("query_id", "vector")
    got = retrieval.dense(v, q, 3).orderBy("query_id", "rank").collect()
    assert [r.chunk_id for r in got if r.query_id == 0] == sorted(range(1, 12), key=lambda i: -math.cos(i))[:3]


@pytest.mark.parametrize(
    ("retrieved", "relevant", "k", "want"),
    [
        ("abc", "ac", 3, (2 / 3, 1.0, 1.0, (1 + 1 / 2) / (1 + 1 / math.log2(3)))),
        ("axy", "ab", 3, (1 / 3, 0.5, 1.0, 1 / (1 + 1 / math.log2(3)))),
        ("x", "", 3, (0.0, 0.0, 0.0, 0.0)),
        ("xay", "a", 2, (0.5, 1.0, 0.5, 1 / math.log2(3))),
        ("xy", "a", 2, (0.0, 0.0, 0.0, 0.0)),
        ("xyzwva", "a", 5, (0.0, 0.0, 1 / 6, 0.0)),
    ],
)
def test_ranking_metrics(spark, retrieved, relevant, k, want):
    ranked = spark.createDataFrame([(1, c, i) for i, c in enumerate(retrieved, 1)], "query_id int, chunk_id string, rank int")
    pairs = spark.createDataFrame([(1, c) for c in relevant], "query_id int, chunk_id string")
    hits, queries = ranking.marked(ranked, pairs, spark.createDataFrame([(1,)], "query_id int"))
    r = ranking.per_query(hits, queries, k).first()
    assert all(abs(a - b) < 1e-9 for a, b in zip((r.precision, r.recall, r.mrr, r.ndcg), want))


def test_macro_of_no_queries(spark):
    none = spark.createDataFrame([], "query_id int, precision double, recall double, mrr double, ndcg double, hit_rank int")
    assert {r.value for r in ranking.macro(none).collect()} == {0.0}


def texts(spark, n=27):
    return spark.createDataFrame([(f"id{i}", f"text {i % 9}") for i in range(n)], "id string, text string")


def test_hash_vectors_and_cache(spark, monkeypatch):
    got = {r.id: r.vector for r in embedding.embedded(texts(spark), "emb_v1").collect()}
    assert len(got["id0"]) == 1024 and got["id0"] == got["id9"] != got["id1"]
    assert abs(sum(x * x for x in got["id0"]) - 1) < 1e-4
    assert embedding.embedded(texts(spark, 0), "emb_v2").collect() == []
    key = text.content_hash(F.lit("BAAI/bge-m3"), F.lit("text 0"))
    cache = spark.range(1).select(key.alias("key"), F.array(F.lit(1.0).cast("float")).alias("vector"))
    mixed = {r.id: r.vector for r in embedding.embedded(texts(spark), "emb_v1", cache=cache).collect()}
    assert mixed["id0"] == [1.0] and len(mixed["id1"]) == 1024 and len(mixed) == 27


def test_index_migration(spark, tmp_path):
    index, chunks = embedding.Index(spark, str(tmp_path)), texts(spark)
    index.create()
    sinks.upsert_points(embedding.embedded(chunks, "emb_v1"), f"{tmp_path}/points")
    sinks.upsert_points(embedding.embedded(texts(spark, 20), "emb_v2"), f"{tmp_path}/points")
    assert {r.version: (r.covered, r.active) for r in index.status(chunks).collect()} == {"emb_v1": (27, True), "emb_v2": (20, False)}
    with pytest.raises(ValueError):
        index.cutover(chunks, "emb_v2")
    assert index.meta()["active"] == "emb_v1"
    assert index.backfill(chunks, "emb_v2") == 7 and index.backfill(chunks, "emb_v2") == 0
    index.cutover(chunks, "emb_v2")
    assert index.meta()["active"] == "emb_v2"
    index.active_view("points")
    assert spark.table("points").count() == 27
    index.rollback("emb_v1")
    assert index.meta()["active"] == "emb_v1" and index.points().count() == 54
    with pytest.raises(LookupError):
        index.introduce("emb_v9")


def test_shadow_gate(spark):
    m = lambda *v: spark.createDataFrame(list(zip(["precision@5", "mrr", "ndcg@5"], v)), "metric string, value double")
    passed = lambda a, b, t: all(r.passed for r in monitoring.shadow(a, b, t).collect())
    assert passed(m(0.3, 0.8, 0.8), m(0.1, 0.8, 0.9), 0.01)
    assert passed(m(0.3, 0.8, 0.8), m(0.3, 0.795, 0.8), 0.01) and not passed(m(0.3, 0.8, 0.8), m(0.3, 0.795, 0.8), 0.001)
