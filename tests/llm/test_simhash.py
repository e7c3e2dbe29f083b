import random

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash
from tessera.llm.components import connected_components

DDL = "doc_id long, text string, fp string, root int, label string"


def brute_fingerprint(text, k=4):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return 0
    sh = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, limit=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= limit:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(ids))]


def sample_docs():
    rng = random.Random(5)
    words = [f"w{i}É" for i in range(60)]
    rows = []
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 30, 200]))]
        for c in range(4):
            copy = list(base)
            if c and len(copy) > 10:
                copy[rng.randrange(len(copy))] = "Changed"
            rows.append((g * 10 + c, " ".join(copy).upper() if c == 2 else "\n".join(copy)))
    rows += [(900, None), (901, ""), (902, " \t\n"), (None, "lone text of no id"), (None, None), (7, "x"), (7, "x"), (905, "word " * 70_000)]
    return [(i, t, "clash", 1, "label") for i, t in rows]


def test_whole_result_against_brute_force(spark):
    rows = sample_docs()
    got = simhash.simhash_components(spark.createDataFrame(rows, DDL), 4, 4).collect()
    prints = [brute_fingerprint(r[1]) for r in rows]
    roots = brute_components([r[0] for r in rows], prints)
    want = sorted(((r[0] is None, r[0] or 0, f"{p:016x}", c if c is not None else -1) for r, p, c in zip(rows, prints, roots)))
    assert sorted((g[0] is None, g[0] or 0, g[1], g[2] if g[2] is not None else -1) for g in got) == want


def test_empty_table(spark):
    assert simhash.simhash_components(spark.createDataFrame([], DDL)).collect() == []


def near_words(n, seed):
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    words = centre[rng.integers(0, 6, n)]
    for _ in range(5):
        words ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    return np.unique(np.concatenate([words, rng.integers(0, 1 << 63, n, dtype=np.uint64)]))


def test_tree_finds_every_pair():
    words = near_words(900, 3)
    gray = words.copy()
    for s in (1, 2, 4, 8, 16, 32):
        gray ^= gray >> np.uint64(s)
    f = words[np.argsort(gray)]
    got = {p for i, j in simhash.tree_pairs(f, 4) for p in zip(i.tolist(), j.tolist())}
    d = np.bitwise_count(f[:, None] ^ f[None, :])
    i, j = np.nonzero(np.triu(d <= 4, 1))
    assert got == set(zip(i.tolist(), j.tolist())) and len(got) > 500


def test_large_buckets_are_cut_and_lose_no_link(spark):
    words = near_words(250, 4)
    df = spark.createDataFrame([(int(x),) for x in words.view(np.int64)], "fp long")
    edges = simhash.hamming_edges(df, 4, bucket_rows=16).collect()
    want = brute_components(list(range(len(words))), [int(x) for x in words])
    at = {int(x): i for i, x in enumerate(words.view(np.int64))}
    root = list(range(len(words)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for e in edges:
        assert bin(int(words[at[e.a]]) ^ int(words[at[e.b]])).count("1") <= 64
        a, b = find(at[e.a]), find(at[e.b])
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(words))] == want
    assert len(set(want)) < len(words)


def test_components_of_a_path_a_star_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(300, 300), (None, 1)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[100 + i] == 100 for i in range(1, 50)) and all(got[200 + i] == 200 for i in range(1, 9))
    assert 300 not in got


DOC = "doc_id long, text string"


def some_words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_copies_that_repeat_a_line_more_often_are_found(spark):
    rng, rows = random.Random(11), []
    for g in range(20):
        body, line = some_words(rng, 120), some_words(rng, 12)
        rows += [(2 * g, " ".join(body + line)), (2 * g + 1, " ".join(body + line * 21))]
    got = dict(simhash.similar_components(spark.createDataFrame(rows, DOC)).collect())
    assert all(got[i] == i - i % 2 for i, _ in rows)


def edited(rng, base, kind):
    n = len(base)
    if kind == "cut":
        return base[: int(0.82 * n)]
    if kind == "longer":
        return base + some_words(rng, int(0.2 * n))
    if kind == "other end":
        return base[: int(0.91 * n)] + some_words(rng, n - int(0.91 * n))
    at = int(0.5 * n)
    return base[:at] + some_words(rng, int(0.09 * n)) + base[at + int(0.09 * n) :]


def brute_jaccard(a, b, k=5):
    u, v = ({tuple(t[i : i + k]) for i in range(max(1, len(t) - k + 1))} for t in (a, b))
    return len(u & v) / len(u | v)


def test_cut_longer_and_spliced_copies_are_found(spark):
    rng, rows, want = random.Random(12), [], {}
    for g in range(600):
        base = some_words(rng, 300)
        copy = edited(rng, base, ("cut", "longer", "other end", "spliced")[g % 4])
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
        want |= {2 * g: 2 * g, 2 * g + 1: 2 * g + (brute_jaccard(base, copy) < 0.8)}
    got = dict(simhash.similar_components(spark.createDataFrame(rows, DOC)).collect())
    assert sum(i != c for i, c in want.items()) > 500
    assert got == want


def brute_similar(texts):
    words = [t.split() for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and brute_jaccard(words[i], words[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


@pytest.mark.parametrize("most", [256, 4, 1])
def test_template_texts_do_not_hide_a_pair_and_chains_of_copies_stay_whole(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST", most)
    rng, texts = random.Random(13), []
    template = some_words(rng, 170)
    for _ in range(150):
        texts.append(template + some_words(rng, 27))
    for _ in range(20):
        twin = template + some_words(rng, 27)
        texts += [twin, twin[:-20] + some_words(rng, 20)]
    for _ in range(5):
        word = some_words(rng, 200)
        for _ in range(30):
            texts.append(list(word))
            at = rng.randrange(180)
            word[at : at + 12] = some_words(rng, 12)
    texts = [" ".join(t) for t in texts]
    want = brute_similar(texts)
    assert len(set(want[:190])) == 170
    got = dict(simhash.similar_components(spark.createDataFrame(list(enumerate(texts)), DOC)).collect())
    assert [got[i] for i in range(len(texts))] == want


def test_hot_buckets_are_cut_and_every_open_pair_is_still_verified(spark):
    rng, texts = random.Random(14), []
    template = some_words(rng, 170)
    for _ in range(60):
        texts.append(template + some_words(rng, 27))
    for _ in range(12):
        twin = template + some_words(rng, 27)
        texts += [twin, twin[:-20] + some_words(rng, 20)]
    texts = [" ".join(t) for t in texts]
    got = dict(simhash.similar_components(spark.createDataFrame(list(enumerate(texts)), DOC), bucket_rows=16, text_rows=8).collect())
    assert [got[i] for i in range(len(texts))] == brute_similar(texts)


def test_open_pairs_come_up_once_and_similar_sets_join_what_brute_force_joins():
    rng = np.random.default_rng(15)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(150, 200)], rng.integers(0, 1 << 63, rng.integers(0, 30), dtype=np.uint64)])) for _ in range(60)]
    i, j = np.triu_indices(60, 1)
    label = simhash.similar_sets(sets, iter([(i[::2], j[::2]), (i[1::2], j[1::2])]), 0.8).label
    root = list(range(60))
    for u, v in zip(i.tolist(), j.tolist()):
        both = len(np.intersect1d(sets[u], sets[v]))
        if both / (len(sets[u]) + len(sets[v]) - both) >= 0.8:
            low, high = sorted((root[u], root[v]))
            root = [low if r == high else r for r in root]
    assert label.tolist() == root and 1 < len(set(root)) < 60


def test_wide_fingerprint_is_the_vote_of_all_shingles():
    hashes = np.random.default_rng(16).integers(0, 1 << 63, 700, dtype=np.uint64)
    for h in (hashes, hashes[:1], hashes[:4]):
        words = [h, *(simhash._mixed(h + m) for m in simhash.MIX)]
        want = [sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in w) > len(h)) for w in words]
        assert simhash.wide_fingerprint(h).tolist() == want


def pairs_of_similarity(rng, shingles, n):
    for _ in range(n):
        h = rng.integers(0, 1 << 63, shingles, dtype=np.uint64)
        same = -(-shingles * 8 // 9)
        yield simhash.wide_fingerprint(h), simhash.wide_fingerprint(np.concatenate([h[:same], rng.integers(0, 1 << 63, shingles - same, dtype=np.uint64)]))


@pytest.mark.parametrize("shingles", [9, 90, 450])
def test_fingerprints_of_a_similarity_of_four_fifths_meet_and_are_near(shingles):
    words = np.stack([w for pair in pairs_of_similarity(np.random.default_rng(17), shingles, 500) for w in pair], axis=1)
    cells = simhash.bucket_keys(words)
    assert len(np.unique(cells[:, 0] >> simhash.KEY_BITS)) == 1 and (cells >> simhash.KEY_BITS == np.arange(simhash.TABLES)).all()
    met = (cells[::2] == cells[1::2]).any(1)
    near = np.bitwise_count(words[:, ::2] ^ words[:, 1::2]).sum(0, dtype=int) <= 70
    assert (met & near).sum() >= 498


@pytest.mark.parametrize("short", [8, 1000])
def test_gray_order_search_of_wide_fingerprints_finds_every_near_pair(short):
    rng = np.random.default_rng(18)
    words = np.stack([w for shingles in (20, 200) for pair in pairs_of_similarity(rng, shingles, 150) for w in pair], axis=1)
    key = rng.integers(0, 3, words.shape[1] // 2).repeat(2)
    gray = words[0].copy()
    for s in (1, 2, 4, 8, 16, 32):
        gray ^= gray >> np.uint64(s)
    order = np.lexsort((gray, key))
    words, key = words[:, order], key[order]
    got = [(a, b, c) for i, j, d in simhash.near_pairs([key], words, 70, short=short) for a, b, c in zip(i.tolist(), j.tolist(), d.tolist())]
    d = np.bitwise_count(words[:, :, None] ^ words[:, None, :]).sum(0, dtype=int)
    i, j = np.nonzero(np.triu((d <= 70) & (key[:, None] == key), 1))
    assert sorted(got) == sorted(zip(i.tolist(), j.tolist(), d[i, j].tolist())) and len(got) >= 298
