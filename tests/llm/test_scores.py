"""Quality, toxicity and language-model scores."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from tessera.llm import lm, quality, toxicity

DDL = "doc_id long, text string, score string, y int, word string, lang string"
EDGE = [(None, "text of no id"), (7001, None), (7002, ""), (7003, "  \n"), (7004, "lone"), (7004, "lone"), (7005, "word É " * 40_000)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 9, "clash", "xx") for i, t in rows], DDL)


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    plain = [a + b for a in ("re", "tion", "sta", "ver", "lo", "mi") for b in ("ka", "den", "ler", "nos", "pi")]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.choice([20, 60, 150]))]
        bad, toxic = rng.random() < 0.2, rng.random() < 0.25
        if toxic:
            for _ in range(max(2, len(words) // 40)):
                words[rng.randrange(len(words))] = rng.choice(["grobz", "Gromph"]) + rng.choice(["", "ka", "den", "ler", "pi"])
        text = " ".join(words)
        if bad:
            text = rng.choice([text.upper().replace(" ", "!! "), " ".join([words[0]] * 60), " | ".join(words)])
        docs.append((i, text))
        # the repeated word may have taken the place of all toxic ones
        labels.append((i, int(not bad), int(any(w.lower().startswith(("grobz", "gromph")) for w in text.split())), "clash"))
    return docs, labels


def test_quality_and_toxicity_of_held_out_documents(spark):
    docs, labels = corpus()
    d, y = table(spark, docs + EDGE), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    for module, column, modulus, fold, cut in ((quality, "quality", 5, 0, 0.3), (toxicity, "toxic", 3, 1, 0.7)):
        got = module.score(d, y).collect()
        assert len(got) == len(docs) + len(EDGE)
        truth = {r[0]: r[1 if column == "quality" else 2] for r in labels}
        held = [r for r in got if r.doc_id in truth and r.held_out]
        assert all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % modulus == fold) for r in got)
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in got)
        assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97 and len(held) > 80
    kept = toxicity.clean(d, y)
    assert kept.columns == d.columns and 0 < kept.count() < d.count()
    assert quality.good(d, y).columns == d.columns


def test_scores_without_labels_or_rows(spark):
    docs, _ = corpus(20)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        got = module.score(table(spark, docs + EDGE), none).collect()
        assert len(got) == len(docs) + len(EDGE) and len({r.score for r in got if r.doc_id in (7001, 7002, 7003)}) == 1
        assert module.score(table(spark, []), none).collect() == []
    got = {r.doc_id: r.predicted for r in toxicity.score(table(spark, [(1, "you pathetic worthless idiot"), (2, "a calm text")]), none).collect()}
    assert got == {1: 1, 2: 0}


def test_trees_are_flat_and_agree_with_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    trees = quality.boost(x, y, trees=20, depth=3)
    p = trees.predict(x)
    assert ((p > 0.5) == y).mean() > 0.95

    def walk(row):
        total = trees.base
        for t in range(len(trees.leaf)):
            node = 0
            while node < trees.feature.shape[1]:
                node = 2 * node + 1 + int(row[trees.feature[t, node]] > trees.edge[t, node])
            total += trees.leaf[t, node - trees.feature.shape[1]]
        return 1 / (1 + math.exp(-total))

    assert np.allclose([walk(r) for r in x[:50]], p[:50])


def test_label_model_trusts_a_lone_voter_and_discounts_copies():
    fires = np.zeros((400, 4))
    fires[:100, 0] = 1
    fires[100:140, 1] = fires[100:140, 2] = 1  # two voters that always agree
    fires[140:180, 3] = 1
    post = toxicity.label_model(fires, np.array([0.8, 0.8, 0.8, 0.8]))
    assert post[:180].min() > 0.7 and post[180:].max() < 0.3
    fires = np.zeros((400, 3))
    fires[:50, 0] = fires[:40, 1] = 1  # the first is believed in the ten rows where it is alone, since the second agrees elsewhere
    fires[50:60, 2] = 1  # nothing speaks for the third
    post = toxicity.label_model(fires, np.full(3, 0.1))
    assert post[:50].min() > 0.7 and post[50:].max() < 0.3


def brute_label_model(fires, trust, rounds):
    """The same expectation maximisation, cell by cell."""
    n, m = fires.shape
    post = [0.02 if not any(row) else 0.9 if sum(row) > 1 else sum(row * trust) for row in fires]
    for _ in range(rounds):
        prior = min(max(sum(post) / n, 1e-3), 1 - 1e-3)
        weight = [[1 - p for p in post], post]
        heard = [sum(fires[i] * trust) if sum(fires[i]) == 1 else post[i] for i in range(n)]
        rate = [[(sum(h * fires[i, j] for i, h in enumerate(own)) + 0.1) / (sum(w) + 0.2) for own, w in zip(([1 - h for h in heard], heard), weight)] for j in range(m)]
        quiet = [(sum(w[i] for i in range(n) if not any(fires[i])) + 0.1) / (sum(w) + 0.2) for w in weight]
        left = [[fires[i, j] - weight[0][i] * rate[j][0] - weight[1][i] * rate[j][1] for j in range(m)] for i in range(n)]
        scale = [math.sqrt(sum(left[i][j] ** 2 for i in range(n)) / n) + 1e-6 for j in range(m)]
        pair = [[0.0 if j == k else sum(left[i][j] * left[i][k] for i in range(n)) / n / scale[j] / scale[k] for k in range(m)] for j in range(m)]
        new = []
        for i in range(n):
            odds = math.log(prior / (1 - prior)) + (0 if any(fires[i]) else math.log(quiet[1] / quiet[0]))
            for j in np.flatnonzero(fires[i]):
                odds += math.log(rate[j][1] / rate[j][0]) / (1 + sum(pair[k][j] for k in np.flatnonzero(fires[i]) if pair[k][j] > 0.3))
            new.append(1 / (1 + math.exp(-odds)))
        post = new
    return post


def test_label_model_against_brute_force():
    rng = np.random.default_rng(4)
    truth = rng.random(150) < 0.3
    fires = (rng.random((150, 6)) < np.where(truth[:, None], [0.6, 0.5, 0.4, 0.3, 0.3, 0.2], [0.02, 0.1, 0.01, 0.05, 0.02, 0.0])).astype(float)
    fires[:, 5] = fires[:, 0] * (rng.random(150) < 0.9)
    trust = np.array([0.8, 0.8, 0.3, 0.3, 0.8, 0.3])
    post = toxicity.label_model(fires, trust, rounds=5)
    assert np.allclose(post, brute_label_model(fires, trust, 5))
    assert post[fires[:, :5].sum(1) > 1].min() > 0.9 and post[~fires.any(1)].max() < 0.3


def test_a_sample_is_bounded_in_rows(spark):
    docs = table(spark, [(4, f"text {i}") for i in range(300)] + [(i, "x") for i in range(10, 60)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(100)], "doc_id long, quality int, toxic int")
    from tessera.llm.common import labelled_sample

    for bound in (2, 50, 1000):
        got, again = (Counter(labelled_sample(d, labels, "toxic", 3, 1, bound).collect()) for d in (docs, docs.repartition(3)))
        assert got.total() <= bound and got == again and (bound < 50 or got)


def brute_ppm(streams, order):
    """Plain dictionaries of counts over whole texts, scored by the textbook recursion."""
    counts = {}
    for text in streams:
        s = b"\n" * order + text + b"\n"
        for i in range(order, len(s)):
            for d in range(order + 1):
                counts.setdefault(s[i - d : i], Counter())[s[i]] += 1

    def log10(text):
        s, total = b"\n" * order + text + b"\n", 0.0
        for i in range(order, len(s)):
            gone = set()
            for d in range(order, -1, -1):
                if s[i - d : i] not in counts:
                    continue
                seen = {k: v for k, v in counts[s[i - d : i]].items() if k not in gone}
                whole = sum(seen.values()) + len(seen)
                if s[i] in seen:
                    total += math.log10(seen[s[i]] / whole)
                    break
                if whole:
                    total += math.log10(len(seen) / whole)
                gone |= set(seen)
            else:
                total -= math.log10(max(1, 256 - len(gone)))
        return total

    return log10


def brute_lm(rows, order):
    train, streams = Counter(), []
    for i, t in rows:
        if lm.is_training(i):
            train.update([*words_of(t), ""])
            streams.append(" ".join(words_of(t)).encode())
    n, v, ppm, want, known = sum(train.values()), len(train), brute_ppm(streams, order), Counter(), {}
    for i, t in rows:
        w = [*words_of(t), ""]
        base = sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w)
        stream = " ".join(w[:-1]).encode()
        if stream not in known:
            known[stream] = ppm(stream)
        want[i, not lm.is_training(i), len(w), sum(train[x] > 0 for x in w), n, round(base, 3), round(known[stream], 3)] += 1
    return want


def listed(got):
    return Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3), round(r.score, 3)) for r in got)


def test_lm_scores_against_brute_force(spark, monkeypatch):
    docs, _ = corpus(120)
    held = next(i for i in range(9000, 9100) if not lm.is_training(i))
    rows = [*docs, *EDGE[:-1], (held, "Quite OTHER bytes: éß中 77!"), (9002, "word É " * 3000), (None, None)]
    want = brute_lm(rows, lm.ORDER)
    assert listed(lm.score(table(spark, rows)).collect()) == want
    # chunks and shards of every size give the same
    for name, small in (("CHUNK", 4000), ("SLICE", 1000), ("SHARD", 5000)):
        monkeypatch.setattr(lm, name, small)
    assert listed(lm.score(table(spark, rows).repartition(3)).collect()) == want
    assert listed(lm.score(table(spark, rows), order=2).collect()) == brute_lm(rows, 2)


def test_lm_scores_of_nothing_and_of_held_out_texts_alone(spark):
    assert lm.score(table(spark, [])).collect() == []
    held = next(i for i in range(100) if not lm.is_training(i))
    alone = lm.score(table(spark, [(held, "a b")])).first()
    assert (alone.n_tokens, alone.n_known, alone.train_tokens) == (3, 0, 0) and math.isclose(alone.score, -4 * math.log10(256))


def test_lm_reads_across_words_and_tells_copies_apart(spark):
    rng = random.Random(5)
    held = [i for i in range(9000) if not lm.is_training(i)]
    train = [i for i in range(9000) if lm.is_training(i)]
    pair = {w: rng.sample([a + b for a in ("ka", "lo", "mi", "tu") for b in ("ren", "sol", "pik")], 2) for w in (a + b for a in ("ka", "lo", "mi", "tu") for b in ("ren", "sol", "pik"))}

    def text(n):
        w = ["karen"]
        while len(w) < n:
            w.append(rng.choice(pair[w[-1]]))
        return w

    asked = [text(60) for _ in range(20)]
    mixed = [rng.sample(w, len(w)) for w in asked]
    rare = ["".join(rng.choice("qxyzjvw") for _ in range(120)) for _ in range(2)]
    rows = [(i, " ".join(text(80))) for i in train[:200]]
    rows += [(train[300], rare[0]), (train[301], rare[1]), (train[302], rare[1])]
    rows += [(i, " ".join(w)) for i, w in zip(held, [*asked, *mixed])]
    got = {r.doc_id: r for r in lm.score(table(spark, rows)).collect()}
    plain, shuffled = ([got[i] for i in held[a : a + 20]] for a in (0, 20))
    assert all(p.score > s.score + 1 for p, s in zip(plain, shuffled))
    assert sum(r.score for r in plain) > sum(r.base_score for r in plain)
    assert got[train[301]].score > got[train[300]].score + 5 and got[train[301]].score == got[train[302]].score


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_copies_of_a_toxic_text_teach_no_words(spark):
    rng = random.Random(8)
    plain = [a + b for a in ("re", "tion", "sta", "ver", "lo", "mi") for b in ("ka", "den", "ler", "nos", "pi")]
    docs, labels = [], []
    for i in range(400):
        toxic = i % 8 == 0
        words = [rng.choice(plain) for _ in range(60)] + [f"own{i}x{k}" for k in range(20)]
        docs.append((i, " ".join(words + ["grobzka"] * 3 * toxic)))
        labels.append((i, 1, int(toxic), ""))
    copied = docs[0][1].split() + ["quirrel", "quirrel"]
    for i in range(400, 440):
        copied[rng.randrange(50)] = "edit"
        docs.append((i, " ".join(copied)))
        labels.append((i, 1, 1, ""))
    model = toxicity.train(table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"))
    stems = {s.rstrip("$") for s, _ in model.stems}
    assert any("grobzka".startswith(s) for s in stems) and not any("quirrel".startswith(s) for s in stems)
