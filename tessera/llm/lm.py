"""Language-model scores by prediction by partial matching over byte contexts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder, written

#: Longest context in bytes.
ORDER = 5
#: The byte that stands before a text, as often as a context is long, and that ends it; no word holds it.
STOP = b"\n"
SYMBOLS = 256
#: Bytes of text whose distinct contexts are listed together, of text that is looked at at once, and of text for each shard.
CHUNK, SLICE, SHARD = 32 << 20, 4 << 20, 16 << 20
#: What a row of an inventory, of a chunk's values and of texts is about.
GRAM, WORD, TEXT = 0, 1, 2


def is_training(doc_id, modulus: int = 7, held_out: int = 2) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus != held_out


def stream_of(text: str | None) -> bytes:
    """The words of a text, A-Z in lower case, with one space for each gap."""
    return b" ".join(text.encode().lower().split()) if text else b""


def grams_of(streams: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(grams, start): each byte of the streams, and the end of each, behind the `order` bytes before it, as one number;
    and where each stream's grams start. Contexts run over the whole stream, from STOPs before it on."""
    whole = b"".join([STOP * order + s + STOP for s in streams]) + bytes(8)
    size = np.array([len(s) for s in streams], np.int64)
    begin = np.cumsum(size + order + 1) - (size + order + 1)
    n = len(whole) - 8 - order
    if not streams or n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.ndarray((n,), ">u8", whole, 0, (1,)).astype(np.uint64)
    grams = (at >> np.uint64(8 * (7 - order))).view(np.int64)
    keep = np.ones(n, bool)  # not those whose symbol is a STOP before the next stream
    keep[(begin[1:, None] - order + np.arange(order)).ravel()] = False
    return grams[keep], np.cumsum(size + 1) - (size + 1)


def packed(numbers: np.ndarray) -> bytes:
    """Eight-byte numbers, their first bytes first, compressed."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(data: bytes, kind=np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences."""
    return packed(np.diff(keys, prepend=np.int64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data))


def packed_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(1).compress(b" ".join(words))


def unpacked_words(data: bytes) -> list[bytes]:
    return zstandard.decompress(data).split(b" ")


def words_of(streams: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """(words, words of each stream)."""
    if not streams:
        return pa.array([], pa.binary()), np.zeros(0, np.int64)
    lists = pc.split_pattern(pa.array(streams, pa.binary()), pattern=b" ")
    n, words = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten()
    empty = np.array([not s for s in streams])
    if empty.any():  # nothing gives one empty word
        words = words.filter(pc.not_equal(words, pa.scalar(b"", pa.binary())))
        n[empty] = 0
    return words, n


def sums_of(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the counts of each."""
    k, c = np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *counts])
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def word_sums(tables: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(tables) if tables else pa.table({"w": pa.array([], pa.binary()), "c": pa.array([], pa.int64())})
    return whole.group_by("w").aggregate([("c", "sum")]).rename_columns(["w", "c"])


def placed(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk, train, size, stream) of every row, stored; a chunk is about CHUNK bytes of neighbouring texts."""

    def place(batches):
        chunk, held = TaskContext.get().partitionId() << 32, 0
        for b in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            ids, streams, chunks = b["doc_id"].to_pylist(), [stream_of(t) for t in b["text"].to_pylist()], []
            for s in streams:
                if held and held + len(s) > CHUNK:
                    chunk, held = chunk + 1, 0
                held += len(s) + 1
                chunks.append(chunk)
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(chunks, pa.int64()), pa.array([is_training(i) for i in ids], pa.bool_()), pa.array([len(s) + 1 for s in streams], pa.int64()), pa.array(streams, pa.binary())],
                names=["doc_id", "chunk", "train", "size", "stream"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows.mapInArrow(place, "doc_id long, chunk long, train boolean, size long, stream binary"))


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[tuple[int, list]]:
    """(chunk, rows) of neighbouring texts of one chunk, about `size` bytes at a time."""
    held, chunk, rows = 0, None, []
    for b in batches:
        for r in zip(b["chunk"].to_pylist(), b["train"].to_pylist(), b["stream"].to_pylist()):
            if rows and (r[0] != chunk or held + len(r[2]) > size):
                yield chunk, rows
                held, rows = 0, []
            chunk = r[0]
            rows.append(r)
            held += len(r[2])
    if rows:
        yield chunk, rows


def inventory(texts: DataFrame, shards: int, order: int) -> DataFrame:
    """(kind, shard, chunk, keys, counts): each chunk's distinct grams and words with their counts in training texts, by shard, stored.

    Grams and words that only held-out texts have come with 0. Lists travel as one value for each chunk and shard.
    """

    def lists(chunk, keys, counts, tables):
        gram, n = sums_of(keys, counts)
        shard = gram % shards
        by = np.argsort(shard, kind="stable")
        ends = np.flatnonzero(np.append(shard[by][1:] != shard[by][:-1], True)) + 1 if len(by) else []
        start = 0
        for e in ends:
            at = by[start:e]
            yield GRAM, int(shard[at[0]]), chunk, packed_keys(gram[at]), packed(n[at])
            start = e
        words = word_sums(tables)
        own, c = words["w"].to_pylist(), words["c"].to_numpy()
        shard = np.array([zlib.crc32(w) % shards for w in own], np.int64)
        by = np.argsort(shard, kind="stable")
        ends = np.flatnonzero(np.append(shard[by][1:] != shard[by][:-1], True)) + 1 if len(by) else []
        start = 0
        for e in ends:
            at = by[start:e]
            yield WORD, int(shard[at[0]]), chunk, packed_words([own[i] for i in at]), packed(c[at].astype(np.int64))
            start = e

    def rows(out):
        kind, shard, chunk, keys, counts = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(shard, pa.int64()), pa.array(chunk, pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=["kind", "shard", "chunk", "keys", "counts"])

    def run(batches):
        now, keys, counts, tables = None, [], [], []
        for chunk, part in slices(batches):
            if chunk != now and now is not None:
                yield rows(lists(now, keys, counts, tables))
                keys, counts, tables = [], [], []
            now = chunk
            for train in (True, False):
                own = [s for _, t, s in part if t == train]
                gram, n = np.unique(grams_of(own, order)[0], return_counts=True)
                keys.append(gram)
                counts.append(n * train)
                words = words_of(own)[0].value_counts()
                tables.append(pa.table({"w": words.field("values"), "c": pa.array(words.field("counts").to_numpy() * train, pa.int64())}))
            if len(keys) > 16:  # one list for each kind while the chunk goes on
                k, c = sums_of(keys, counts)
                keys, counts, tables = [k], [c], [word_sums(tables)]
        if now is not None:
            yield rows(lists(now, keys, counts, tables))

    return written(texts.select("chunk", "train", "stream").mapInArrow(run, "kind int, shard long, chunk long, keys binary, counts binary"))


def by_shard(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of equal keys, out of batches sorted by them."""
    now, held = None, []
    for b in batches:
        for r in b.to_pylist():
            own = tuple(r[k] for k in keys)
            if own != now and held:
                yield now, held
                held = []
            now = own
            held.append(r)
    if held:
        yield now, held


def totals(listed: DataFrame) -> DataFrame:
    """(kind, shard, gram, word, c): every distinct gram and word with its count in all training texts, stored."""

    def run(batches):
        for (kind, shard), rows in by_shard(batches, ["kind", "shard"]):
            counts = [unpacked(r["counts"]) for r in rows]
            if kind == GRAM:
                k, c = sums_of([unpacked_keys(r["keys"]) for r in rows], counts)
                gram, word = pa.array(k), pa.nulls(len(k), pa.binary())
            else:
                t = word_sums([pa.table({"w": pa.array(unpacked_words(r["keys"]), pa.binary()), "c": c}) for r, c in zip(rows, counts)])
                word, c = t["w"].combine_chunks(), t["c"].to_numpy()
                gram = pa.nulls(len(c), pa.int64())
            n = len(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind), pa.int32()), pa.array(np.full(n, shard), pa.int64()), gram, word, pa.array(c, pa.int64())], names=["kind", "shard", "gram", "word", "c"])

    dealt = listed.select("kind", "shard", "keys", "counts").repartition("kind", "shard").sortWithinPartitions("kind", "shard")
    return written(dealt.mapInArrow(run, "kind int, shard long, gram long, word binary, c long"))


def suffix(gram: Column, length: int) -> Column:
    """The last `length` bytes."""
    return gram.bitwiseAND(F.lit((1 << (8 * length)) - 1))


def trie(grams: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, contexts) of the byte-context trie of grams (gram, c), both stored.

    pairs: depth d, key (a context of d bytes and a symbol) and n, how often it occurs. contexts: depth, ctx, t (all symbols'
    occurrences), q (distinct symbols, the escape estimate of method C) and e, what its symbols count in the context that is one
    byte shorter: they can't come after an escape to it, so they are left out there.
    """
    seen = grams.where("c > 0")
    each = seen.select("c", F.explode(F.array(*(F.struct(F.lit(d).alias("d"), suffix(F.col("gram"), d + 1).alias("key")) for d in range(order + 1)))).alias("p"))
    pairs = written(each.groupBy("p.d", "p.key").agg(F.sum("c").alias("n")))
    shorter = pairs.select((F.col("d") + 1).alias("d"), F.col("key").alias("short"), F.col("n").alias("n_short"))
    met = pairs.withColumn("short", F.expr("key & (shiftleft(1L, 8 * d) - 1)")).join(shorter, ["d", "short"], "left")
    contexts = met.groupBy("d", F.shiftright("key", 8).alias("ctx")).agg(F.sum("n").alias("t"), F.count("*").alias("q"), F.coalesce(F.sum("n_short"), F.lit(0)).alias("e"))
    return pairs, written(contexts)


def gram_costs(grams: DataFrame, order: int) -> DataFrame:
    """(shard, gram, cost): log10 probability of each gram's symbol in its context, with escapes to shorter contexts and exclusion.

    Grams of the training texts end in their longest context. The others look up every suffix: contexts of a byte and of none are
    256 and 65,536 symbols in them at most, so these are broadcast, and longer ones meet in shuffle joins.
    """
    pairs, contexts = trie(grams, order)
    top = contexts.where(F.col("d") == order).select("ctx", "t", "q")
    seen = grams.where("c > 0").withColumn("ctx", F.shiftright("gram", 8)).join(top, "ctx").select("shard", "gram", (F.log10("c") - F.log10(F.col("t") + F.col("q"))).alias("cost"))
    new = grams.where("c = 0").select("shard", "gram")
    long = [d for d in range(order, -1, -1) if d >= 2]
    stats = ["t", "q", "e", "n"]
    if long:
        each = new.select("shard", "gram", F.explode(F.array(*(F.struct(F.lit(d).alias("d"), suffix(F.col("gram"), d + 1).alias("key"), F.shiftright(suffix(F.col("gram"), d + 1), 8).alias("ctx")) for d in long))).alias("p")).select("shard", "gram", "p.*")
        each = each.join(contexts.where("d >= 2"), ["d", "ctx"], "left").join(pairs.where("d >= 2"), ["d", "key"], "left")
        new = each.groupBy("shard", "gram").agg(*(F.max(F.when(F.col("d") == d, F.col(c))).alias(f"{c}{d}") for d in long for c in stats))
    for d in range(min(order, 1), -1, -1):
        c = contexts.where(F.col("d") == d).select(F.col("ctx").alias("_ctx"), *(F.col(x).alias(f"{x}{d}") for x in "tqe"))
        p = pairs.where(F.col("d") == d).select(F.col("key").alias("_key"), F.col("n").alias(f"n{d}"))
        new = new.join(F.broadcast(c), F.shiftright(suffix(F.col("gram"), d + 1), 8) == F.col("_ctx"), "left").drop("_ctx")
        new = new.join(F.broadcast(p), suffix(F.col("gram"), d + 1) == F.col("_key"), "left").drop("_key")
    cost, still = F.lit(0.0), F.lit(True)
    for d in range(order, -1, -1):
        zero = F.lit(0)
        left_out, kinds_out = (F.coalesce(F.col(f"{c}{d + 1}"), zero) if d < order else zero for c in "eq")
        escape = F.col(f"q{d}") - kinds_out
        total = F.col(f"t{d}") - left_out + escape
        step = F.when(F.col(f"n{d}").isNotNull(), F.log10(f"n{d}") - F.log10(total)).when(F.col(f"t{d}").isNotNull() & (escape > 0), F.log10(escape) - F.log10(total)).otherwise(F.lit(0.0))
        cost = cost + F.when(still, step).otherwise(F.lit(0.0))
        still = still & F.col(f"n{d}").isNull()
    unseen = F.greatest(F.lit(1), F.lit(SYMBOLS) - F.coalesce("q0", F.lit(0)))
    cost = cost - F.when(still, F.log10(unseen)).otherwise(F.lit(0.0))
    return seen.unionByName(new.select("shard", "gram", cost.alias("cost")))


def chunk_values(listed: DataFrame, known: DataFrame, costs: DataFrame) -> DataFrame:
    """(kind, chunk, keys, numbers): the costs of each chunk's grams and the counts of its words, by shard."""

    def run(batches):
        kinds = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("numbers", pa.binary())])
        now, gram, value, words = None, [], [], {}
        for b in batches:
            out = []
            for r in b.to_pylist():
                if (r["kind"], r["shard"]) != now:
                    now, gram, value, words = (r["kind"], r["shard"]), [], [], {}
                if r["chunk"] is None:
                    if r["kind"] == GRAM:
                        gram.append(r["gram"])
                        value.append(r["value"])
                    else:
                        words[r["word"]] = int(r["value"])
                elif r["kind"] == GRAM:
                    if isinstance(gram, list):
                        gram, value = np.array(gram, np.int64), np.array(value, float)
                        order = np.argsort(gram)
                        gram, value = gram[order], value[order]
                    out.append((GRAM, r["chunk"], r["keys"], packed(value[np.searchsorted(gram, unpacked_keys(r["keys"]))])))
                else:
                    out.append((WORD, r["chunk"], r["keys"], packed(np.array([words[w] for w in unpacked_words(r["keys"])], np.int64))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*out), kinds)], schema=kinds)

    null = lambda kind: F.lit(None).cast(kind)
    entries = known.where(F.col("kind") == WORD).select("kind", "shard", null("long").alias("chunk"), null("long").alias("gram"), "word", F.col("c").cast("double").alias("value"), null("binary").alias("keys"))
    entries = entries.unionByName(costs.select(F.lit(GRAM).alias("kind"), "shard", null("long").alias("chunk"), "gram", null("binary").alias("word"), F.col("cost").alias("value"), null("binary").alias("keys")))
    asked = listed.select("kind", "shard", "chunk", null("long").alias("gram"), null("binary").alias("word"), null("double").alias("value"), "keys")
    both = entries.unionByName(asked).repartition("kind", "shard").sortWithinPartitions("kind", "shard", F.asc_nulls_first("chunk"))
    return both.mapInArrow(run, "kind int, chunk long, keys binary, numbers binary")


class Scorer:
    """Scores streams by the costs of a chunk's grams and the counts of its words."""

    def __init__(self, grams: list, words: list, order: int, n: int, v: int, ends: int):
        key = np.concatenate([np.zeros(0, np.int64), *(unpacked_keys(k) for k, _ in grams)])
        cost = np.concatenate([np.zeros(0), *(unpacked(c, float) for _, c in grams)])
        by = np.argsort(key, kind="stable")
        self.key, self.cost, self.order = key[by], cost[by], order
        self.words = pa.array([w for k, _ in words for w in unpacked_words(k)], pa.binary())
        self.counts = np.concatenate([np.zeros(0, np.int64), *(unpacked(c) for _, c in words)])
        self.least, self.ends = np.log10(n + v + 1), ends

    def score(self, streams: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, known tokens, base score, score) of each stream."""
        gram, start = grams_of(streams, self.order)
        by = np.argsort(gram)
        run = gram[by]
        first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        cost = np.empty(len(gram))
        cost[by] = np.repeat(self.cost[np.searchsorted(self.key, run[first])], np.diff(np.append(first, len(run))))
        words, n = words_of(streams)
        listed = words.dictionary_encode()
        count = self.counts[pc.index_in(listed.dictionary, value_set=self.words).to_numpy(zero_copy_only=False)][listed.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(n)), n)
        known = np.bincount(doc, count > 0, len(n)).astype(np.int64) + (self.ends > 0)
        base = np.bincount(doc, np.log10(count + 1), len(n)) + np.log10(self.ends + 1) - (n + 1) * self.least
        return n + 1, known, base, np.add.reduceat(cost, start)


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    base_score is the smoothed unigram log10 probability of the tokens (words with A-Z in lower case, then one end).
    score is the log10 probability of the text by prediction by partial matching, with one white space for each
    gap: the code length of its bytes and its end in contexts of up to `order` bytes that run over the whole text, words
    and gaps alike, with escapes by method C and symbol exclusion. Both learn from all training documents, and from
    every context in them, whatever the input's size.

    What costs a look-up is a distinct gram (a symbol with its longest context) of a chunk of neighbouring texts, not each place
    in a text: chunks list their grams, the trie gives each distinct gram's cost, and the costs go back to the chunks, which sum them up.
    Lists are dealt by shards whose number grows with the bytes of text, so that a task holds a shard or a chunk.

    Null texts count as empty: an end alone. Repeated rows each get a row, equal texts equal scores; a null doc_id counts as
    empty text in the fold. An empty table gives no rows; with no training document every count is 0 and all bytes cost alike. A very long
    text is a chunk of its own. Only doc_id and text are read, so further columns of any name don't matter.
    """
    texts = placed(docs)
    size, ends = texts.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.when(F.col("train"), 1))).first()
    listed = inventory(texts, -(-size // SHARD) | 1, order)
    known = totals(listed)
    n, v = known.where(F.col("kind") == WORD).agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    n, v = n + ends, v + (ends > 0)
    values = chunk_values(listed, known, gram_costs(known.where(F.col("kind") == GRAM).select("shard", "gram", "c"), order))

    def run(batches):
        chunk, grams, words, scorer, held, size = None, [], [], None, [], 0

        def flushed():
            tokens, known_tokens, base, own = scorer.score([s for _, s in held])
            return pa.RecordBatch.from_arrays([pa.array([d for d, _ in held], pa.int64()), pa.array(tokens), pa.array(known_tokens), pa.array(base), pa.array(own)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

        for b in batches:
            for r in zip(*(b[c].to_pylist() for c in ("chunk", "kind", "keys", "numbers", "doc_id"))):
                if r[0] != chunk:
                    if held:
                        yield flushed()
                    chunk, grams, words, scorer, held, size = r[0], [], [], None, [], 0
                if r[1] == TEXT:
                    if scorer is None:
                        scorer = Scorer(grams, words, order, n, v, ends)
                        grams, words = [], []
                    if held and size + len(r[2]) > SLICE:
                        yield flushed()
                        held, size = [], 0
                    held.append((r[4], r[2]))
                    size += len(r[2])
                else:
                    (grams if r[1] == GRAM else words).append((r[2], r[3]))
        if held:
            yield flushed()

    null = lambda kind: F.lit(None).cast(kind)
    rows = texts.select("chunk", F.lit(TEXT).alias("kind"), F.col("stream").alias("keys"), null("binary").alias("numbers"), "doc_id")
    both = reduce(DataFrame.unionByName, [rows, values.select("chunk", "kind", "keys", "numbers", null("long").alias("doc_id"))])
    scored = both.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")
