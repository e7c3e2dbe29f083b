"""Packing documents into fixed windows by deficit round-robin over source queues."""

from __future__ import annotations

import base64
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .buckets import runs_of
from .common import written
from .mixing import source_key

#: Tokens of a window, and windows that one task packs at a time.
WINDOW, SPAN = 2048, 256
END = 1
SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids of texts by a tokenizer file, then the end id.

    Where a file of the same vocabulary as ranks lies beside the tokenizer's (name.tiktoken for name.json), the
    ids come from it, since it is several times as fast; the ids are the same. Texts
    with the special token's string, and those the fast way fails on, go by the tokenizer itself.
    """

    def __init__(self, path: str, fast: bool = True):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.slow = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.slow.get_vocab_size() <= 1 << 16 else np.uint32
        self.quick = None
        ranks = f"{path.removesuffix('.json')}.tiktoken"
        if fast and os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        out = None
        if text and self.quick and SPECIAL not in text:
            try:
                out = self.quick.encode_ordinary(text)
            except BaseException as e:  # the library's panics aren't Exceptions
                if isinstance(e, KeyboardInterrupt | SystemExit):
                    raise
        if out is None:
            out = self.slow.encode(text, add_special_tokens=False).ids if text else []
        return np.array([*out, END], self.kind)


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, source, n, ids (little-endian, two or four bytes each), part and before, stored.

    before: tokens of the same source that come before the document in its part.
    """

    def encode(batches):
        encoder, held, part = Encoder(path), {}, TaskContext.get().partitionId()
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            ids, before = [encoder.ids(t) for t in batch["text"].to_pylist()], []
            for s, x in zip(batch["source"].to_pylist(), ids):
                before.append(held.get(s, 0))
                held[s] = before[-1] + len(x)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["source"], pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([part] * len(ids), pa.int32()), pa.array(before, pa.int64())],
                names=["doc_id", "source", "n", "ids", "part", "before"],
            )

    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text")
    return written(rows.mapInArrow(encode, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, n long, ids binary, part int, before long"))


class Queues:
    """How far each source's queue has come at any token of the packed whole.

    A source gives tokens at the rate of its weight until its queue ends; what it no longer gives the others take over, in
    proportion to their weights. given() has what is due at a time, in whole tokens, and at() what has been given at a token:
    both never fall, and at() sums up to the token exactly.
    """

    def __init__(self, size: np.ndarray, weight: np.ndarray):
        self.size = size.astype(float)
        self.rate = np.maximum(weight / weight.sum(), 1e-9)
        self.end = float((self.size / self.rate).max()) * (1 + 1e-9) + 1
        self.known: dict[int, tuple[np.ndarray, float]] = {}

    def given(self, time: np.ndarray) -> np.ndarray:
        return np.clip(np.ceil(self.rate * time[:, None] - 0.5), 0, self.size).astype(np.int64)

    def at(self, token: int) -> tuple[np.ndarray, float]:
        """(tokens of each source before this token, the time)."""
        if token not in self.known:
            if len(self.known) > 10_000:
                self.known.clear()
            lo, hi = 0.0, self.end
            while lo < (mid := (lo + hi) / 2) < hi:
                lo, hi = (lo, mid) if self.given(np.array([mid])).sum() >= token else (mid, hi)
            low, high = self.given(np.array([lo, hi]))
            more = high - low
            self.known[token] = low + np.clip(token - low.sum() - (np.cumsum(more) - more), 0, more), hi
        return self.known[token]

    def span_of(self, source: int, place: int, span: int) -> int:
        """Which stretch of `span` tokens takes the token at this place of a source's queue."""
        n = int(self.given(np.array([(place + 0.5) / self.rate[source]])).sum()) // span
        while place < self.at(n * span)[0][source]:
            n -= 1
        while place >= self.at((n + 1) * span)[0][source]:
            n += 1
        return n


def deal(left: np.ndarray, rate: np.ndarray, deficit: np.ndarray, window: int) -> np.ndarray:
    """(windows, sources): tokens that each source gives to each window, by deficit round-robin.

    In each window every source that has tokens left is credited its share of the window, by its rate among those, and gives the whole tokens of
    its deficit; what rounding and ended queues leave open goes to the largest deficits, a token in turn. Deficits are carried to
    the next window. Only the last window may be short.
    """
    left, deficit, out = left.astype(np.int64).copy(), deficit.astype(float).copy(), []
    while (held := int(left.sum())) > 0:
        room, active = min(window, held), left > 0
        deficit[active] += room * rate[active] / rate[active].sum()
        give = np.clip(np.floor(deficit), 0, left).astype(np.int64)
        while (short := room - int(give.sum())) > 0:
            open_ = np.flatnonzero(left > give)
            turn = open_[np.argsort(give[open_] - deficit[open_], kind="stable")]
            quantum = max(1, short // len(turn))
            more = np.minimum(left[turn] - give[turn], quantum)
            give[turn] += np.clip(short - (np.cumsum(more) - more), 0, more)
        while (over := int(give.sum()) - room) > 0:
            some = np.flatnonzero(give)
            give[some[np.argsort(deficit[some] - give[some], kind="stable")][:over]] -= 1
        deficit -= give
        left -= give
        out.append(give)
    return np.array(out, np.int64).reshape(len(out), len(left))


def cuts(gives: np.ndarray, lengths: list[np.ndarray], window: int) -> np.ndarray:
    """Rows (window, offset, source, row of the source's queue, start in that row, place in the queue, length) of all pieces, in order."""
    inner = np.cumsum(gives, 1) - gives  # where each source starts in each window
    out = []
    for s, own in enumerate(lengths):
        upto, ends = np.cumsum(gives[:, s]), np.cumsum(own)
        marks = np.unique(np.concatenate([[0], upto, ends]))
        lo, hi = marks[:-1], marks[1:]
        row, w = np.searchsorted(ends, lo, "right"), np.searchsorted(upto, lo, "right")
        out.append(np.stack([w, inner[w, s] + lo - (upto[w] - gives[w, s]), np.full(len(lo), s), row, lo - (ends[row] - own[row]), lo, hi - lo], 1))
    made = np.concatenate(out)
    return made[np.lexsort((made[:, 1], made[:, 0]))]


def pack(docs: DataFrame, path: str, window: int = WINDOW, weights: dict | None = None, with_ids: bool = False, span: int = SPAN) -> DataFrame:
    """Pieces of all documents in sequences of `window` tokens without gaps.

    One row a piece: doc_id, source, start (the document's ids before it), length, ids_crc32 (of the ids as unsigned 32-bit little-endian),
    doc_tokens, sequence_id, offset, and ids if asked for. Only the last sequence may be short.
    weights: target proportion of each source; by default its share of all tokens, which
    makes all queues end together. A source that is used up leaves its share to the others, one without weight comes last.

    A source's documents stand in one queue, by prefix sums over parts of the input. Stretches of `span` windows are packed each by a
    task of their own: it takes from each queue what `Queues` has due there, carries over the deficits with which the
    stretches before it end, and deals its windows by deficit round-robin, so that each window of the whole keeps to the proportions within a
    token or two a source and a task holds the ids of one stretch. One number a source is sent to the driver and back to the tasks.

    Null and empty texts are the end id alone; a null source is a source of its own; repeated rows are packed each, those of null or
    repeated ids too; a document longer than its source's share of a window runs over several. An empty table gives no rows. Only doc_id, text and source are
    read, so further columns of any name don't matter.
    """
    rows = tokenised(docs, path).withColumn("key", source_key(F.col("source")))
    sums = written(rows.groupBy("key", "source", "part").agg(F.sum("n").alias("n")))
    total = sorted(sums.groupBy("key", "source").agg(F.sum("n").alias("n")).collect(), key=lambda r: (r.source is None, r.source or ""))
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {doc_type}, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    columns += ", ids array<long>" if with_ids else ""
    if not total:
        return docs.sparkSession.createDataFrame([], columns)
    size = np.array([r.n for r in total], np.int64)
    weight = np.array([(weights or {}).get(r.source, 0.0) if weights else r.n for r in total], float)
    names, number = [r.source for r in total], {r.source: i for i, r in enumerate(total)}
    kind = Encoder(path, fast=False).kind
    long_span = span * window
    before = W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("key", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    queued = rows.join(starts, ["key", "part"]).select("doc_id", "source", "n", "ids", (F.col("first") + F.col("before")).alias("place"))

    def stretches(batches):
        """The stretch of each document in each span."""
        own = Queues(size, weight)
        for b in batches:
            made = []
            for i, (s, n, place) in enumerate(zip(b["source"].to_pylist(), b["n"].to_pylist(), b["place"].to_pylist())):
                s = number[s]
                for at in range(own.span_of(s, place, long_span), own.span_of(s, place + n - 1, long_span) + 1):
                    lo = max(place, int(own.at(at * long_span)[0][s]))
                    hi = min(place + n, int(own.at((at + 1) * long_span)[0][s]))
                    made.append((at, s, lo, i, lo - place, hi - place))
            at = pa.array([m[3] for m in made], pa.int64())
            ids = [b["ids"][m[3]].as_buffer() for m in made]
            wide = np.dtype(kind).itemsize
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([m[k] for m in made], pa.int64()) for k in (0, 1, 2)), b["doc_id"].take(at), b["n"].take(at), pa.array([m[4] for m in made], pa.int64()), pa.array([x[m[4] * wide : m[5] * wide].to_pybytes() for x, m in zip(ids, made)], pa.binary())],
                names=["span", "s", "place", "doc_id", "n", "start", "ids"],
            )

    def place(batches):
        own = Queues(size, weight)
        for t in runs_of(batches, ["span"]):
            spans = t["span"].to_numpy()
            for at in np.unique(spans):
                yield windows_of(t.filter(pa.array(spans == at)), int(at), own)

    def windows_of(t, at, own):
        s, n_docs = t["s"].to_numpy(), t["n"].to_numpy()
        ids = [np.frombuffer(x, kind) for x in t["ids"].to_pylist()]
        long = np.array([len(x) for x in ids], np.int64)
        rows_of = [np.flatnonzero(s == k) for k in range(len(names))]
        queue = [np.concatenate([np.zeros(0, kind), *(ids[i] for i in r)]) for r in rows_of]
        given, time = own.at(at * long_span)
        deficit = np.where([len(q) > 0 for q in queue], np.clip(np.minimum(own.rate * time, own.size) - given, -1, 1), 0)
        made = cuts(deal(np.array([len(q) for q in queue]), own.rate, deficit, window), [long[r] for r in rows_of], window)
        row = np.array([rows_of[k][r] for k, r in made[:, 2:4]], np.int64)
        piece = [queue[k][a : a + m] for k, a, m in zip(made[:, 2], made[:, 5], made[:, 6])]
        take = pa.array(row)
        out = [t["doc_id"].take(take).combine_chunks(), pa.array([names[k] for k in made[:, 2]], pa.string()), pa.array(made[:, 4] + t["start"].to_numpy()[row]), pa.array(made[:, 6]),
               pa.array([zlib.crc32(c.astype("<u4").tobytes()) for c in piece], pa.int64()), pa.array(n_docs[row]), pa.array(at * span + made[:, 0]), pa.array(made[:, 1])]
        named = ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            out.append(pa.array([c.astype(np.int64) for c in piece], pa.list_(pa.int64())))
            named.append("ids")
        return pa.RecordBatch.from_arrays(out, names=named)

    cut = queued.mapInArrow(stretches, f"span long, s long, place long, doc_id {doc_type}, n long, start long, ids binary")
    return cut.repartition("span").sortWithinPartitions("span", "s", "place").mapInArrow(place, columns)
