"""Top-k search and embedding near-dedup."""

import numpy as np

from tessera.llm import embed_dedup, topk

DDL = "vec_id long, embedding array<float>, label int, score long, v string"
ODD = [(901, None), (902, [None, 1.0]), (903, [float("nan")] * 8), (904, [float("inf")] + [0.0] * 7), (905, []), (906, [0.0] * 8), (None, [1.0] * 8), (907, [3.0]), (908, [1.5, 1.5])]


def rows(n=220, width=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    x[::7] *= 9  # lengths differ
    x[60:90] = x[60] + rng.normal(size=(30, width)) * 0.02
    x[100:110] = x[100]
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]


def frame(spark, data):
    return spark.createDataFrame([(i, v, 1, 2, "clash") for i, v in data], DDL)


def test_topk_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 32)
    monkeypatch.setattr(topk, "QUERIES", 8)
    monkeypatch.setattr(topk, "SEEDS", 16)
    data = rows() + ODD + [(3, rows()[3][1]), (150, [100.0] * 8), (20, rows()[20][1])]
    got = topk.topk(frame(spark, data), lambda c: c % 5 == 0, k=5).collect()
    fit = [(i, v) for i, v in data if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    ints = [(i, np.array([int(np.floor(256 * c)) for c in v] + [0] * (8 - len(v)), object)) for i, v in fit]
    want = []
    for q, (i, v) in enumerate(ints):  # rows that repeat an id are queries and candidates of their own
        if i % 5 == 0:
            others = sorted((-int((w * v).sum()), j) for c, (j, w) in enumerate(ints) if c != q)
            want += [(i, r, j, -s) for r, (s, j) in enumerate(others[:5], 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_topk_finds_a_row_that_repeats_its_query(spark):
    got = topk.topk(frame(spark, [(5, [1.0, 2.0]), (5, [1.0, 2.0]), (6, [1.0, 0.0])]), lambda c: c % 5 == 0, k=2).collect()
    assert sorted(map(tuple, got)) == [(5, 1, 5, 5 * 65536)] * 2 + [(5, 2, 6, 65536)] * 2


def test_topk_of_few_rows_and_large_numbers(spark):
    assert topk.topk(frame(spark, []), lambda c: c % 5 == 0).collect() == []
    assert topk.topk(frame(spark, [(5, [1.0])]), lambda c: c % 5 == 0).collect() == []
    big = [(0, [3e12, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 2.0])]
    wide = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    got = topk.topk(wide, lambda c: c % 5 == 0, k=2).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(2, 256 * int(3e12) * 256 + 512 * 256), (1, 256 * int(3e12) * 256 + 256 * 256)]


def brute_links(data, threshold):
    fit = sorted({(i, tuple(v) + (0.0,) * (8 - len(v))) for i, v in data if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)})
    x = np.array([v for _, v in fit])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    root = list(range(len(fit)))
    for _ in range(len(fit)):
        new = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(len(fit))]
        if new == root:
            break
        root = new
    return {k: (int(near[i].sum()), fit[root[i]][0]) for i, k in enumerate(fit)}


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BUCKET", 12)  # the dense groups are cut into pieces
    data = rows() + ODD + [(3, rows()[3][1]), (150, rows()[20][1])]
    got = embed_dedup.near_duplicates(frame(spark, data), 0.95).collect()
    assert len(got) == len(data)
    want = brute_links(data, 0.95)
    truth = {}
    for (i, _), x in want.items():
        truth.setdefault(i, set()).add(x)
    found = sum(r.n_links for r in got if r.vec_id in truth)
    assert found >= 0.95 * sum(want[i, tuple(v) + (0.0,) * (8 - len(v))][0] for i, v in data if i in truth)
    right = sum((r.n_links, r.component_id) in truth[r.vec_id] for r in got if r.vec_id in truth)
    assert right >= 0.95 * sum(i in truth for i, _ in data)
    alone = {r.vec_id: tuple(r)[1:] for r in got if r.vec_id not in truth}
    assert alone[901] == (0, 901, True) and alone[906] == (0, 906, True) and alone[None][0] == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    for functions in (1, 2, 3):
        tables = int(np.ceil(np.log(embed_dedup.MISSED) / np.log(1 - embed_dedup.KEPT**functions)))
        x, y = (embed_dedup.codes(v, tables, functions, 2) for v in (a, b))
        met = (x[:, :, :, None] == y[:, :, None, :]).any((1, 2, 3))
        assert met.mean() > 0.95


def test_no_rows(spark):
    assert embed_dedup.near_duplicates(frame(spark, [])).collect() == []
    assert [tuple(r) for r in embed_dedup.near_duplicates(frame(spark, [(4, None)])).collect()] == [(4, 0, 4, True)]


def test_doubles_are_compared_in_full(spark):
    side = (1 - 0.95**2) ** 0.5
    data = [(1, [1.0, 0.0]), (2, [0.95, side - 1e-10]), (3, [0.95, side + 1e-10])]  # alike as floats
    got = embed_dedup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links) for r in got) == [(1, 1), (2, 2), (3, 1)]
