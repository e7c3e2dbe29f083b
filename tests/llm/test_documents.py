"""License scans, packing, mixing, WARC archives and the pipeline."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import licenses, mixing, packing, queries, simhash, warc

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DDL = "doc_id long, text string, lang string, source string, n_chars long, size long, label string, part int"
EDGE = [(None, "no id all rights reserved", "a"), (801, None, "a"), (802, "", None), (803, " \t\n", "é"), (804, "lone", None), (805, "all rights reserved " * 9_000, "a"), (805, "cc by", "b")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "xx", s, len(t or ""), 5, "clash", 3) for i, t, s in rows], DDL)


def rows(n=90, seed=3):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "délta", "eps1", "zeta-eta", "by", "cc", "rights"]
    out = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.choice([1, 5, 40, 400]))]
        for phrase in rng.sample(["CC-BY", "All  Rights, reserved", "GNU General Public License", "KC BY", "Licensed under the Apache License, Version 2.0", "released under MIT license"], rng.randrange(3)):
            w.insert(rng.randrange(len(w) + 1), phrase)
        out.append((i, " ".join(w), rng.choice(["s1", "s1", "s1", "s2", "s3", None])))
    return out + EDGE


def base_of(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    found = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_base_phrases_against_brute_force(spark):
    data = rows()
    data.append(data[7])  # a repeated row
    got = licenses.scan(frame(spark, data)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter((i, *base_of(t)) for i, t, _ in data)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert licenses.scan(frame(spark, [])).collect() == []


def test_changed_notices_are_spans(spark):
    grant = next(p for p, x in licenses.NOTICES.items() if x == "bsd").split()
    less = grant[:6] + grant[7:]  # a word left out shifts the diagonal
    more = grant[:9] + ["very"] + grant[9:]
    half = grant[:8]
    data = [(1, "x " * 50 + " ".join(less), "a"), (2, " ".join(more).upper(), "a"), (3, " ".join(half), "a"), (4, " ".join(reversed(grant)), "a")]
    got = {r.doc_id: r.labels for r in licenses.scan(frame(spark, data)).collect()}
    assert got == {1: "bsd", 2: "bsd", 3: "", 4: ""}


def test_packing_is_exact(spark):
    data = [*rows(), (900, "<|endoftext|> and more", "s1"), (901, " " * 300 + "x" * 3000 + "\n" * 50, "s2")]
    data.append(data[3])
    got = packing.pack(frame(spark, data), TOKENIZER, window=256, with_ids=True).collect()
    encode = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for i, t, _ in data:
        want[i, tuple([*encode.encode(t or "", add_special_tokens=False).ids, 1])] += 1
    whole = {}
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        whole.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, tuple(r.ids)))
    for (i, n), parts in whole.items():
        times = sum(c for (j, ids), c in want.items() if j == i and len(ids) == n)
        assert sum(len(x) for _, x in parts) == n * times
        for ids in {k[1] for k in want if k[0] == i and len(k[1]) == n}:
            assert all(any(ids[s : s + len(x)] == x for (j, ids) in want if j == i and len(ids) == n) for s, x in parts)
    assert set(whole) == {(i, len(ids)) for i, ids in want}
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for n, parts in windows.items():
        parts.sort()
        assert [o for o, _ in parts] == [sum(x for _, x in parts[:k]) for k in range(len(parts))]
        assert sum(x for _, x in parts) == 256 or n == max(windows)
    assert sorted(windows) == list(range(len(windows)))
    assert packing.pack(frame(spark, []), TOKENIZER).collect() == []


def test_windows_keep_to_the_proportions():
    sizes = np.array([5003, 2001, 997, 13, 1])
    gives = packing.deal(sizes, sizes / sizes.sum(), np.zeros(5), 250)
    assert (gives.sum(0) == sizes).all() and (gives.sum(1)[:-1] == 250).all() and (gives >= 0).all()
    assert (np.abs(gives[:-1] - 250 * sizes / sizes.sum()) < 3).all()
    assert (np.abs(np.cumsum(gives, 0)[:-1] - np.arange(1, len(gives))[:, None] * 250 * sizes / sizes.sum()) < 3).all()  # deficits don't pile up
    even = packing.deal(np.array([1000, 300]), np.array([0.5, 0.5]), np.zeros(2), 100)
    assert even[:6].tolist() == [[50, 50]] * 6 and even[6:].tolist() == [[100, 0]] * 7


def test_queues_come_forward_together():
    for size, weight in (([5000, 70, 3, 1], None), ([500, 400, 9], [1.0, 5.0, 0.0])):
        own = packing.Queues(np.array(size), np.array(weight or size, float))
        seen = np.array([own.at(t)[0] for t in range(0, sum(size) + 1, 7)] + [own.at(sum(size))[0]])
        assert (seen.sum(1)[:-1] == np.arange(0, sum(size) + 1, 7)).all() and (seen[-1] == size).all() and (np.diff(seen, axis=0) >= 0).all()
        for s, n in enumerate(size):
            for place in range(0, n, 13):
                at = own.span_of(s, place, 64)
                assert own.at(at * 64)[0][s] <= place < own.at((at + 1) * 64)[0][s]


def test_packed_windows_hold_the_target_shares_over_partitions(spark):
    rng = random.Random(2)
    data = [(i, "word " * rng.choice([5, 50, 900]), rng.choice("aaaabbc")) for i in range(400)]
    got = packing.pack(frame(spark, data).repartition(5), TOKENIZER, window=256, span=4).collect()
    total, held = Counter(), {}
    for r in got:
        total[r.source] += r.length
        held.setdefault(r.sequence_id, Counter())[r.source] += r.length
    last = max(held)
    assert len(held) > 100 and sum(total.values()) == sum(r.length for r in got)
    for w, own in held.items():
        assert w == last or all(abs(own[s] - 256 * n / sum(total.values())) <= 3 for s, n in total.items())
    weighed = packing.pack(frame(spark, data).repartition(3), TOKENIZER, window=256, weights={"a": 1, "b": 1, "c": 1}, span=4)
    first = Counter()
    for r in weighed.where("sequence_id < 20").collect():
        first[r.source] += r.length
    assert all(abs(n - 20 * 256 / 3) <= 3 for n in first.values()) and len(first) == 3


def brute_targets(sizes, share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > cap * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing_against_brute_force(spark):
    data = [*rows(), (910, "one two three", "s3"), (910, "one two three", "s3")]
    df = frame(spark, data)
    got = mixing.taken(df, block_words=64).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in data:
        sizes[s] += size(t)
    target = brute_targets(sizes)
    by_id = {i: s for i, _, s in data if i != 805}
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, size(t)) for i, t, _ in data)
    assert all(abs(r.target - target[by_id[r.doc_id]]) < 1e-6 and r.source_size == sizes[by_id[r.doc_id]] for r in got if r.doc_id != 805)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    taken = Counter()
    for r in got:
        taken[r.source_size] += r.taken
    assert all(abs(taken[sizes[s]] - sum(round(target[x]) for x in sizes if sizes[x] == sizes[s])) <= 1 for s in sizes)
    assert sorted(map(str, mixing.taken(df, block_words=64).collect())) == sorted(map(str, got))
    assert mixing.taken(frame(spark, [])).collect() == []


def test_any_stretch_of_the_schedule_is_mixed(spark):
    plan = spark.createDataFrame([("+a", 50_000), ("+b", 30_000), ("-", 20_000)], "key string, quota long")
    got = sorted(mixing.schedule(plan, 100).collect(), key=lambda r: r.slot)
    assert Counter(r.key for r in got) == {"+a": 500, "+b": 300, "-": 200}
    for at in range(0, 1000, 100):
        part = Counter(r.key for r in got[at : at + 100])
        if at < 700:
            assert abs(part["+a"] - 50) <= 8 and abs(part["-"] - 20) <= 8
    for k in ("+a", "+b", "-"):
        assert [r.block for r in got if r.key == k] == list(range(len([r for r in got if r.key == k])))


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mixed_texts_hold_what_is_taken(spark):
    data = [*rows(), (None, "of no id at all", "s1"), (None, "of no id at all", "s1"), (None, "another of none", "s2"), (910, "one two three", "s3"), (910, "one two three", "s3"), (910, "other text", "s3")]
    df = frame(spark, data).selectExpr("*", "7 AS uid", "'x' AS row", "'y' AS slot", "1 AS words")
    dose, words = Counter(), Counter()
    for r in mixing.taken(df).collect():
        dose[r.doc_id] += r.taken
    out = mixing.mixed(df)
    assert out.columns == df.columns
    texts = {}
    for i, t, _ in data:
        texts.setdefault(i, []).append(t or "")
    for r in out.collect():
        assert r.n_chars == len(r.text) and any(t.startswith(r.text) for t in texts[r.doc_id]) and (r.uid, r.row, r.slot) == (7, "x", "y")
        words[r.doc_id] += n_words(r.text)
    assert +dose == words and mixing.mixed(frame(spark, [])).collect() == []


def test_the_mix_comes_in_the_order_of_the_schedule(spark, monkeypatch):
    data = [(i, f"w{i} " * 40, "a" if i % 3 else "b") for i in range(600)]
    df = frame(spark, data)
    monkeypatch.setattr(mixing, "PARTITION_WORDS", 5000)
    out = [(r.source, n_words(r.text)) for r in mixing.mixed(df, block_words=160).collect()]
    goal = Counter()
    for s, n in out:
        goal[s] += n
    part = Counter()
    for at, (s, n) in enumerate(out):
        part[s] += n
        if at % 100 == 99:
            so_far = sum(part.values())
            assert all(abs(part[x] - so_far * goal[x] / sum(goal.values())) < 3 * 160 for x in goal)


def test_without_slots_nothing_is_taken(spark, monkeypatch):
    df, drawn = frame(spark, rows()), mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda *a, **k: drawn(*a, **k).where("block % 2 = 0"))
    half = mixing.taken(df, block_words=64).collect()
    monkeypatch.setattr(mixing, "schedule", lambda *a, **k: drawn(*a, **k).where("false"))
    none = mixing.taken(df, block_words=64).collect()
    assert len(none) == len(half) == len(rows()) and 0 < sum(r.taken for r in half) and sum(r.taken for r in none) == 0
    assert mixing.mixed(df, block_words=64).collect() == []


def pages():
    big = "é" + "x" * 1200
    out = [(i, f"http://h/{i}?a=b c\r\nX: y", f"<p>{i}</p>" * (i * 9 % 200)) for i in range(60)]
    out += [(100 + i, "http://copy", big) for i in range(40)] + [(200 + i, "http://small", "tiny") for i in range(5)]
    return [*out, (300, None, None), (301, "u", ""), (139, "http://copy", big), (None, "u", big), (None, None, "x" * 5000), (302, "u", "y" * 300_000)]


def test_warc_round_trip(spark):
    data = pages()
    df = spark.createDataFrame([(*r, "clash", 1) for r in data], "page_id long, url string, html string, payload string, digest int")
    index = warc.write(df, archive=20_000)
    got = warc.read(index, with_payload=True).collect()
    assert len(got) == len(data) and index.select("file").distinct().count() > 1
    import hashlib

    last = {}
    for i, _, h in data:
        if i is not None and len((h or "").encode()) >= 1000:
            last[h] = max(last.get(h, i), i)
    want = Counter()
    for i, _, h in data:
        raw = (h or "").encode()
        again = h in last and i != last[h]
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last[h] if again else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got if r.record_type == "response")
    some = index.where("page_id % 10 = 3")
    assert {r.page_id for r in warc.read(some).collect()} == {r[0] for r in data if r[0] is not None and r[0] % 10 == 3}
    assert warc.read(warc.write(df.where("false"))).collect() == []


def test_ranges_are_coalesced_and_bounded():
    spots = [(0, 10), (10, 10), (25, 5), (1000, 10), (1010, 90), (1100, 500)]
    assert list(warc.ranges(spots, gap=10, most=120)) == [(0, 3, 0, 30), (3, 5, 1000, 100), (5, 6, 1100, 500)]


def test_one_of_each_group_of_copies_stays(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(900)]
    data, groups = [], []
    for g in range(12):
        base = [rng.choice(words) for _ in range(300)]
        ids = []
        for c in range(rng.choice([1, 3, 6])):
            copy = list(base)
            for _ in range(2 if c else 0):
                copy[rng.randrange(300)] = "edit"
            ids.append(len(data))
            data.append((len(data), " ".join(copy), "a"))
        groups.append(ids)
    shared = " ".join(rng.choice(words) for _ in range(60))
    clean = [(500 + i, shared + " " + " ".join(rng.choice(words) for _ in range(240)), "b") for i in range(8)]
    df = frame(spark, [*data, *clean, (900, None, "a"), (901, "", "a"), (902, "same", "a"), (902, "same", "a"), (None, "same", "a"), (None, "only without an id", "a"), (None, "only without an id", "a"), (903, "Same", "a"), (903, "unique text of a repeated id", "a")])
    out = simhash.without_copies(df)
    kept = Counter(r.doc_id for r in out.collect())
    assert out.columns == df.columns
    assert all(kept[ids[0]] == 1 and sum(kept[i] for i in ids) == 1 for ids in groups)
    assert all(kept[i] == 1 for i, *_ in clean) and kept[900] == 1 and kept[901] == 0 and kept[902] == 1 and kept[None] == 1 and kept[903] == 1
    assert Counter(r.text for r in out.collect() if r.doc_id in (None, 903)) == {"only without an id": 1, "unique text of a repeated id": 1}
    assert simhash.without_copies(frame(spark, [])).collect() == [] and simhash.without_copies(frame(spark, [(1, "alone " * 50_000, "a")])).count() == 1


def test_near_dedup_finds_copies_by_their_simhash(spark, monkeypatch):
    rng = random.Random(19)
    data = []
    for g in range(20):
        base = [f"w{rng.randrange(900)}" for _ in range(200)]
        data += [(2 * g, " ".join(base), "a"), (2 * g + 1, " ".join(base[:180]), "a")]
    df = frame(spark, data)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_copies(spark, df, "").collect()) == list(range(0, 40, 2))
    # with fingerprints that say nothing of the shingles no copy is found: the similarity only confirms what they find
    monkeypatch.setattr(simhash, "wide_fingerprint", lambda hashes: np.random.default_rng(int(hashes[0] ^ hashes[-1]) + len(hashes)).integers(0, 1 << 63, 4, dtype=np.uint64))
    assert corpus_pipeline.drop_copies(spark, df, "").count() == 40


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf)
        after.write.parquet(path := f"{tmp_path}/{name.replace(' ', '_')}")
        after = spark.read.parquet(path)
        if name != "packing":
            assert after.columns == docs.columns
        if name in ("toxicity", "quality", "simhash near-dedup"):
            assert 0 < after.count() < before.count()
            assert after.join(before, after.columns, "left_anti").count() == 0
        before = after
    assert before.agg({"length": "sum"}).first()[0] > 0
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_every_query_is_named_for_its_operator():
    assert [re.match(r"op(\d+)_", k)[1] for k in queries.queries()] == [str(n) for n in range(1, 11)]
