"""Toxicity scores by weak supervision: many voters, a label model, a linear classifier."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, remainder, written

WORD = re.compile(r"[^\W\d_]+")
#: Insults that vote whatever the labels say.
LEXICON = [
    "idiot", "idiots", "moron", "morons", "imbecile", "cretin", "stupid", "dumbass", "dimwit", "halfwit", "fool", "loser", "losers", "failure", "pathetic", "worthless", "useless",
    "disgusting", "repulsive", "vile", "filthy", "scum", "scumbag", "vermin", "trash", "garbage", "clown", "bastard", "bitch", "asshole", "jerk", "creep", "coward", "pig", "retard",
]
PATTERNS = [
    re.compile(r"\byou(?:'re| are)? (?:all )?(?:an? )?(?:such )?(?:idiot|moron|loser|scum|trash|clown)", re.I),
    re.compile(r"\b(?:shut up|go to hell|drop dead|get lost)\b", re.I),
    re.compile(r"\b(?:hate|despise) (?:you|them|these people)\b", re.I),
    re.compile(r"\b(?:kill|hang|shoot) (?:yourself|yourselves|them all)\b", re.I),
    re.compile(r"\bnobody (?:likes|wants|needs) you\b", re.I),
]
SHORTEST, LONGEST = 3, 8
#: Odd factors of the minimal hashes that tell copies.
MIXERS = [np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) & (2**64 - 1)) for i in range(32)]
#: Labelled rows that may be learnt from at most, words remembered by a task.
SAMPLE, REMEMBERED = 12_000, 300_000
#: P(toxic) to start from where voters agree, where none fires, and where a proposed or a fixed voter fires alone.
AGREED, QUIET, PROPOSED, FIXED = 0.9, 0.02, 0.8, 0.1
#: A stem must fire in so many toxic documents, copies counted once, with this share of all, and by less chance than one in so many candidates.
LEAST, PRECISION, CANDIDATES = 3, 0.8, 200_000


#: A stem votes at a level: some hit; two hits or more that make up this share of all words.
LEVELS = {0: 0.0, 1: 0.0025, 2: 0.01}


def prefixes(word: str):
    """What a lexicon voter may look for in a word: its beginnings, and the whole word as word$."""
    for n in range(SHORTEST, min(len(word), LONGEST) + 1):
        yield word[:n]
    yield f"{word}$"


def levels(hits: int, words: int) -> list[int]:
    return [k for k, share in LEVELS.items() if hits >= (2 if k else 1) and hits >= share * words]


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def stem_hits(counts: Counter) -> Counter:
    hits: Counter = Counter()
    for w, n in counts.items():
        for p in prefixes(w):
            hits[p] += n
    return hits


def _count_stems(batches):
    """(stem, level, grp, good): the groups of toxic documents where a stem fires, and in how many clean ones."""
    kinds = pa.schema([("stem", pa.string()), ("level", pa.int32()), ("grp", pa.int64()), ("good", pa.int64())])
    for batch in batches:
        groups, good = set(), Counter()
        for text, group in zip(batch["text"].to_pylist(), batch["grp"].to_pylist()):
            words = words_of(text)
            fired = [(p, k) for p, n in stem_hits(Counter(words)).items() for k in levels(n, len(words))]
            if group is None:
                good.update(fired)
            else:
                groups.update((p, k, group) for p, k in fired)
        rows = [*groups, *((p, k, None) for p, k in good)]
        yield pa.RecordBatch.from_pydict({"stem": [r[0] for r in rows], "level": [r[1] for r in rows], "grp": [r[2] for r in rows], "good": [0] * len(groups) + list(good.values())}, kinds)


def _least(batches):
    """Minimal hashes of each text's pairs of words."""
    kinds = pa.schema([("row", pa.int64()), ("least", pa.list_(pa.int64()))])
    for b in batches:
        least = []
        for text in b["text"].to_pylist():
            words = words_of(text)
            pairs = {f"{a} {b}" for a, b in zip(words, words[1:])} or {text or ""}
            h = np.array([zlib.crc32(w.encode()) for w in pairs], np.uint64)
            least.append([int(((h * m + m) >> np.uint64(20)).min()) for m in MIXERS])
        yield pa.RecordBatch.from_pydict({"row": b["row"], "least": least}, kinds)


def choose_stems(rows: list[tuple[str, int, int, int]], n_bad: int, n_good: int) -> list[tuple[str, int]]:
    """(stem, level) whose share of toxic documents can't be chance among so many candidates.

    rows: stem, level, and in how many toxic and clean documents it fires, copies counted once. The test is Chernoff's
    bound on the tail of a binomial, against the number of candidates. Of stems that contain one another the strongest stays, the longer first.
    """
    prior = n_bad / max(1, n_bad + n_good)
    if not 0 < prior < 1:
        return []
    found = []
    for stem, level, bad, good in rows:
        p = bad / (bad + good)
        if p < PRECISION:
            continue
        q = min(max(p, 1e-9), 1 - 1e-9)
        evidence = (bad + good) * (q * np.log(q / prior) + (1 - q) * np.log((1 - q) / (1 - prior)))
        if evidence > np.log(CANDIDATES):
            found.append((round(float(evidence), 6), len(stem.rstrip("$")), stem, level))
    out: list[tuple[str, int]] = []
    held, inner = set(), set()  # stems chosen, and all their beginnings
    for _, _, stem, level in sorted(found, key=lambda x: (-x[0], -x[1], x[2], x[3])):
        bare = stem.rstrip("$")
        if bare not in inner and not any(bare[:n] in held for n in range(1, len(bare) + 1)):
            out.append((stem, level))
            held.add(bare)
            inner.update(bare[:n] for n in range(1, len(bare) + 1))
    return out


def learnt_stems(picked: DataFrame) -> list[tuple[str, int]]:
    """Stems for lexicon voters from the labelled sample (row, text, y).

    Copies of a toxic text are put into one group first, so that one text with many copies doesn't make each of its words look toxic; only
    then are stems counted and tested. The sample is bounded, and what passes the test comes to the driver, all of it.
    """
    sizes = {r.y: r.n for r in picked.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return []
    marks = sorted(picked.where("y > 0").mapInArrow(_least, "row long, least array<bigint>").collect())
    group = copies_of(np.array([m.least for m in marks]))
    grouped = picked.sparkSession.createDataFrame([(m.row, int(g)) for m, g in zip(marks, group)], "row long, grp long")
    fired = picked.join(F.broadcast(grouped), "row", "left").select("text", "grp").mapInArrow(_count_stems, "stem string, level int, grp long, good long")
    counted = fired.groupBy("stem", "level").agg(F.count_distinct("grp").alias("bad"), F.sum("good").alias("good"))
    rows = counted.where((F.col("bad") >= LEAST) & (F.col("bad") >= PRECISION * (F.col("bad") + F.col("good")))).collect()
    return choose_stems([tuple(r) for r in rows], int(group.max()) + 1, sizes[0])


def copies_of(least: np.ndarray, alike: float = 0.5) -> np.ndarray:
    """A group number for each row: rows whose minimal hashes agree in `alike` of all places are copies."""
    group = np.arange(len(least))
    for i in range(len(least)):
        near = np.flatnonzero((least[i + 1 :] == least[i]).mean(1) >= alike) + i + 1
        for j in near[group[near] != group[i]]:
            a, b = sorted((group[i], group[j]))
            group[group == b] = a
    return np.unique(group, return_inverse=True)[1]


class Voters:
    """The voters' firings in a text: one for each stem, lexicon word and pattern."""

    def __init__(self, stems: list[tuple[str, int]]):
        lexicon = [(f"{w}$", 0) for w in LEXICON if not any(w.startswith(s.rstrip("$")) for s, _ in stems)]
        self.stems = [*stems, *lexicon]
        self.place = {s: i for i, (s, _) in enumerate(self.stems)}
        self.known: dict[str, tuple[int, ...]] = {}
        self.n = len(self.stems) + len(PATTERNS)

    def of_word(self, word: str) -> tuple[int, ...]:
        hit = self.known.get(word)
        if hit is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            hit = self.known[word] = tuple(self.place[p] for p in prefixes(word) if p in self.place)
        return hit

    def votes(self, text: str | None) -> np.ndarray:
        """Which voters fire."""
        out, hits, words = np.zeros(self.n), Counter(), words_of(text)
        for w, n in Counter(words).items():
            for at in self.of_word(w):
                hits[at] += n
        for at, n in hits.items():
            out[at] = self.stems[at][1] in levels(n, len(words))
        for i, pattern in enumerate(PATTERNS):
            out[len(self.stems) + i] = bool(text and pattern.search(text))
        return out


def features(fires: np.ndarray) -> np.ndarray:
    """Rows of votes into inputs of the linear classifier: a voter that never fires in the sample comes to weigh nothing."""
    return np.column_stack([np.ones(len(fires)), fires])


def label_model(fires: np.ndarray, trust: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Posterior P(toxic) of each row from the voters' agreement alone, by expectation maximisation.

    No row's label is looked at. Classes start from the votes: rows where two voters agree, rows of a lone voter (with its own `trust`: more for a
    proposed one than for one that nothing but the lexicon speaks for), and rows where all abstain. Each voter has a rate
    of firing in each class, P(fire | toxic) and P(fire | clean), and a firing voter's evidence is the logarithm of their ratio; a voter that
    abstains says nothing, but that all of them do is an outcome with rates of its own. Voters that fire together within a class more
    than chance has it don't count in full: a voter's evidence in a row is divided by one and its residual correlations
    with the others that fire there. For a voter's rates a row where it fires alone counts with its trust, as no other voter speaks there: so a
    voter that others agree with comes to be believed alone, and none is by its own word.
    """
    some, lone, alone = fires.any(1), fires.sum(1) == 1, fires @ trust
    post = np.where(fires.sum(1) > 1, AGREED, np.where(some, alone, QUIET))
    for _ in range(rounds):
        prior = np.clip(post.mean(), 1e-3, 1 - 1e-3)
        n = np.array([(1 - post).sum(), post.sum()])
        heard = np.where(lone, alone, post)
        rate = (np.column_stack([fires.T @ (1 - heard), fires.T @ heard]) + 0.1) / (n + 0.2)
        quiet = (np.array([(1 - post)[~some].sum(), post[~some].sum()]) + 0.1) / (n + 0.2)
        left = fires - np.column_stack([1 - post, post]) @ rate.T
        scale = np.sqrt((left**2).mean(0)) + 1e-6
        together = left.T @ left / max(1, len(fires)) / np.outer(scale, scale)
        np.fill_diagonal(together, 0)
        share = fires / (1 + fires @ np.where(together > 0.3, together, 0))
        odds = np.log(prior / (1 - prior)) + share @ np.log(rate[:, 1] / rate[:, 0]) + np.where(some, 0.0, np.log(quiet[1] / quiet[0]))
        post = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
    return post


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression on soft labels, by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    stems: list[tuple[str, int]]
    weights: np.ndarray

    def scorer(self):
        voters, weights = Voters(self.stems), self.weights

        def score(texts: list[str | None]) -> np.ndarray:
            if not texts:
                return np.zeros(0)
            x = features(np.array([voters.votes(t) for t in texts]))
            return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))

        return score


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of a bounded sample of labelled rows; see `score`.

    Labels propose lexicon voters (`learnt_stems`) beside those of the fixed lexicon and patterns, and are not used after that: the label
    model weighs all voters by their agreement, and the classifier learns from its posteriors. Without labelled rows
    of both classes the lexicon and the patterns alone vote.
    """
    picked = written(labelled_sample(docs, labels, "toxic", 3, 1, sample).select("text", "y").withColumn("row", F.monotonically_increasing_id()))
    stems = learnt_stems(picked)
    voters = Voters(stems)

    def votes(batches):
        for batch in batches:
            fired = [np.flatnonzero(voters.votes(t)).tolist() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"fired": fired}, pa.schema([("fired", pa.list_(pa.int32()))]))

    seen = sorted(r.fired for r in picked.mapInArrow(votes, "fired array<int>").collect())  # at most `sample` rows
    fires = np.zeros((len(seen), voters.n))
    for row, fired in zip(fires, seen):
        row[fired] = 1
    # made-up rows, which the label model judges like others: none fires, and each voter of the sample alone; where none fires there, every
    # voter alone and with another
    alone = np.flatnonzero(fires.any(0) if fires.any() else np.ones(voters.n, bool))
    fires = np.vstack([fires, np.zeros((1 if len(alone) < voters.n else 60 * voters.n, voters.n)), *[np.eye(voters.n)[alone]] * 3])
    if not len(seen) or not fires[: len(seen)].any():
        fires = np.vstack([fires, *[np.eye(voters.n) + np.roll(np.eye(voters.n), 1, 1)] * 3])
    trust = np.where(np.arange(voters.n) < len(stems), PROPOSED, FIXED)
    return Model(stems, logistic(features(fires), label_model(fires, trust)))


def score_udf(model: Model):
    stems, weights = list(model.stems), model.weights
    scorers: list = []

    @F.arrow_udf("double")
    def toxic(texts: pa.Array) -> pa.Array:
        if not scorers:
            scorers.append(Model(stems, weights).scorer())
        return pa.array(scorers[0](texts.to_pylist()), pa.float64())

    return toxic


def score(docs: DataFrame, labels: DataFrame, cut: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs.

    score is the classifier's P(toxic) of the whole text, from voters for a lexicon, for stems learnt from
    labelled rows, and for patterns; all abstain in null and empty texts, which
    score low. Repeated rows each get a row, equal texts equal scores; a null doc_id counts as empty text in the fold and has no label. An empty table
    gives no rows. Very long texts are read whole, in one pass. Only doc_id and text are read, and of labels doc_id and toxic, so
    further columns of any name don't matter. An id with several labels counts as toxic if one of them says so.
    """
    model = train(docs, labels)
    scored = docs.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), score_udf(model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, cut: float = 0.7) -> DataFrame:
    """docs without the rows that score `cut` or more; all its columns, and every other row, stay as they are.

    Null, empty, repeated and very long texts, null ids and an empty table go as in `score`.
    """
    udf = score_udf(train(docs, labels))
    return docs.where(udf("text") < cut)
