"""SimHash near-dedup with a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import Forest, pieced, runs_of
from .common import checkpointed, written
from .components import connected_components

SEED = 42
#: Shingles whose bits are unpacked at once.
CHUNK = 1 << 15


def shingles(words: list[bytes], k: int) -> list[bytes]:
    """Space-joined runs of k words; the whole sequence if it is shorter; none of no words."""
    if not words:
        return []
    return [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]


def fingerprint(text: str | None, k: int = 4) -> int:
    """The 64-bit SimHash of a text's word k-shingles, as an unsigned integer (0 for none)."""
    words = text.encode().lower().split() if text else []
    n = max(1, len(words) - k + 1) if words else 0
    votes = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + k - 1]
        h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(part, k)], dtype=">u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprint_udf(k: int):
    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, k) for t in texts.to_pylist()], np.uint64).view(np.int64))

    return of


def blocks_of(bits: int, count: int) -> list[int]:
    """Masks of `count` neighbouring runs of about equal length."""
    ends = [round(bits * i / count) for i in range(count + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(ends, ends[1:])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def gray_rank(column):
    """Place of a 64-bit word in the reflected Gray order, as an expression."""
    g = column
    for shift in (1, 2, 4, 8, 16, 32):
        g = g.bitwiseXOR(F.shiftrightunsigned(g, shift))
    # flips the sign bit, so that signed order is the order of the ranks
    return g.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def bits_set(x: np.ndarray) -> np.ndarray:
    """Number of set bits of words, or of columns of several words."""
    count = np.bitwise_count(x)
    return count if x.ndim == 1 else count.sum(0, dtype=np.int16)


def bits_apart(f: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of bits that rows i and j of f differ in."""
    if f.ndim == 1:
        return np.bitwise_count(f[i] ^ f[j])
    count = np.zeros(len(i), np.int16)
    for word in f:
        count += np.bitwise_count(word[i] ^ word[j])
    return count


def tree_pairs(f: np.ndarray, limit: int, leaf: int = 16, fan: int = 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of Gray-sorted fingerprints that differ in at most `limit` bits: words, or columns of several.

    Upper nodes hold the bits that all their words share (a mask and a value). Pairs of
    nodes whose shared bits already differ in more than `limit` places are dropped with
    all that is under them; the others are opened level by level down to the words.
    """
    n = f.shape[-1]
    levels = []  # from the leaves up: start of each node, mask, value
    start = np.arange(0, n, leaf)
    every, some = np.bitwise_and.reduceat(f, start, axis=-1), np.bitwise_or.reduceat(f, start, axis=-1)
    levels.append((start, ~(every ^ some), every))
    while len(levels[-1][0]) > fan:
        step = np.arange(0, len(levels[-1][0]), fan)
        every, some = np.bitwise_and.reduceat(every, step, axis=-1), np.bitwise_or.reduceat(some, step, axis=-1)
        levels.append((step, ~(every ^ some), every))

    def near(level, a, b):
        _, mask, value = levels[level]
        return bits_set((value[..., a] ^ value[..., b]) & mask[..., a] & mask[..., b]) <= limit

    def opened(a, b, count, width):
        """Pairs of the children of nodes a and b, each once, where i <= j."""
        i = (a[:, None] * width + np.arange(width)).repeat(width, axis=1)
        j = np.tile(b[:, None] * width + np.arange(width), width)
        keep = (i < count) & (j < count) & (i <= j)
        return i[keep], j[keep]

    a, b = np.triu_indices(len(levels[-1][0]))
    todo = [(len(levels) - 1, a, b)]
    while todo:
        level, a, b = todo.pop()
        keep = near(level, a, b)
        a, b = a[keep], b[keep]
        for at in range(0, len(a), 4096):
            pa_, pb_ = a[at : at + 4096], b[at : at + 4096]
            if level:
                i, j = opened(pa_, pb_, len(levels[level - 1][0]), fan)
                todo.append((level - 1, i, j))
            else:
                i, j = opened(pa_, pb_, n, leaf)
                hit = (i < j) & (bits_apart(f, i, j) <= limit)
                if hit.any():
                    yield i[hit], j[hit]


def run_pairs(keys: list[np.ndarray], f: np.ndarray, limit: int, short: int = 48) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) within `limit` bits, of rows of equal keys (sorted by key, then Gray rank)."""
    n = len(f)
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, n))
    run = np.repeat(np.arange(len(start)), length)
    rows = np.flatnonzero((length[run] > 1) & (length[run] <= short))
    end = (start + length)[run]
    lag = 1
    while len(rows := rows[rows + lag < end[rows]]):
        hit = rows[np.bitwise_count(f[rows] ^ f[rows + lag]) <= limit]
        yield hit, hit + lag
        lag += 1
    for s, m in zip(start[length > short], length[length > short]):
        for i, j in tree_pairs(f[s : s + m], limit):
            yield i + s, j + s


def link_runs(keys: list[np.ndarray], f: np.ndarray, limit: int) -> Forest:
    """The groups that the pairs of `run_pairs` join."""
    forest = Forest(len(f))
    for i, j in run_pairs(keys, f, limit):
        forest.join(i, j)
    return forest


def near_pairs(keys: list[np.ndarray], sketch: np.ndarray, limit: int, short: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of rows of equal keys (sorted by key, then Gray rank) whose wide fingerprints differ in at most `limit` bits,
    and how many differ: the whole of short runs, long ones by `tree_pairs`."""
    n = sketch.shape[1]
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, n))
    run = np.repeat(np.arange(len(start)), length)
    rows = length[run] <= short
    for lag in range(1, length[length <= short].max(initial=0)):
        together = np.flatnonzero((run[lag:] == run[:-lag]) & rows[lag:])
        if 4 * len(together) > n:
            d = bits_set(sketch[:, :-lag] ^ sketch[:, lag:])[together]
        else:
            d = bits_apart(sketch, together, together + lag)
        hit = np.flatnonzero(d <= limit)
        if len(hit):
            yield together[hit], together[hit] + lag, d[hit].astype(np.int64)
    for s, m in zip(start[length > short], length[length > short]):
        for i, j in tree_pairs(sketch[:, s : s + m], limit):
            yield i + s, j + s, bits_apart(sketch, i + s, j + s).astype(np.int64)


def pick_pairs(keys: list[np.ndarray], sketch: np.ndarray, sketch_limit: int, most: int, chunk: int = 1 << 17, held_pairs: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): of each row of a bucket pairs with the `most` nearest sketches and the hub.

    The hub is the row, among those within `sketch_limit`, that most rows are clearly near to: the text that the others of
    a group are copies of. So groups give pairs in proportion to their rows.
    """
    n = sketch.shape[1]
    clear = sketch_limit - 9
    degree, hub = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    kept, held, every, total = np.zeros((3, 0), np.int64), 0, [], 0

    def nearest(parts):
        i, j, d = np.concatenate(parts, 1)
        order = np.lexsort((j, d, i))
        i = i[order]
        start = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, np.int64)
        place = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
        return np.stack([i, j[order], d[order]])[:, place < most]

    parts = [kept]
    for i, j, d in near_pairs(keys, sketch, sketch_limit):
        at = d <= clear
        np.add.at(degree, i[at], 1)
        np.add.at(degree, j[at], 1)
        parts.append(np.stack([np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([d, d])]))
        held += 2 * len(i)
        total += len(i)
        if total <= held_pairs:
            every.append((i, j, d))
        else:  # too many to keep: found again
            every = []
        if held > chunk:
            parts = [nearest(parts)]
            held = 0
    i, j, _ = nearest(parts)
    for u, v, _ in (every if total <= held_pairs else near_pairs(keys, sketch, sketch_limit)):
        np.maximum.at(hub, u, (degree[v] << 32) | (n - 1 - v))
        np.maximum.at(hub, v, (degree[u] << 32) | (n - 1 - u))
    rows = np.flatnonzero(hub >= 0)
    return np.concatenate([i, rows]), np.concatenate([j, n - 1 - (hub[rows] & np.int64((1 << 32) - 1))])


def _linker(limit: int, keys: list[str]):
    def run(batches):
        for t in runs_of(batches, keys):
            t = t.combine_chunks()
            f = t["fp"].to_numpy().view(np.uint64)
            label = link_runs([t[k].to_numpy() for k in keys], f, limit).label
            at = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(f[at].view(np.int64)), pa.array(f[label[at]].view(np.int64))], names=["a", "b"])

    return run


def _sketch_words(t: pa.Table) -> np.ndarray:
    return np.stack([t[c].to_numpy().view(np.uint64) for c in SKETCH])


def _picker(keys: list[str], sketch_limit: int, most: int):
    """Pairs of `pick_pairs` with their bucket; every row that is near another row of its bucket is the cid of one."""

    def run(batches):
        for t in runs_of(batches, keys):
            t = t.combine_chunks()
            cid, bits = t["cid"].to_numpy(), t["bits"].to_numpy()
            i, j = pick_pairs([t[k].to_numpy() for k in keys], _sketch_words(t), sketch_limit, most)
            yield pa.RecordBatch.from_arrays([pa.array(bits[i]), pa.array(cid[i]), pa.array(cid[j])], names=["bits", "cid", "other"])

    return run


def open_pairs(t: pa.Table, keys: list[str], sketch_limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of a table of buckets that still want a look at the texts: near by their fingerprints, of different
    roots, and not together in an earlier table nor in another meeting of pieces. So each pair comes up once over all buckets."""
    root, words = t["root"].to_numpy(), _sketch_words(t)
    cells = bucket_keys(words)
    earlier = np.arange(TABLES) < (t["bits"].to_numpy() >> KEY_BITS)[:, None]
    own, one = (t["own"].to_numpy(), t["i"].to_numpy() == t["j"].to_numpy()) if len(keys) > 1 else (None, None)
    for i, j, _ in near_pairs([t[k].to_numpy() for k in keys], words, sketch_limit):
        keep = root[i] != root[j]
        if own is not None:
            keep &= one[i] | (own[i] != own[j])
        i, j = i[keep], j[keep]
        new = ~((cells[i] == cells[j]) & earlier[i]).any(1)
        if new.any():
            yield i[new], j[new]


def _marker(keys: list[str], sketch_limit: int):
    """Rows of buckets that have an open pair there, at most one for each row: never the pairs."""

    def run(batches):
        for t in runs_of(batches, keys):
            t = t.combine_chunks()
            some = np.zeros(t.num_rows, bool)
            for i, j in open_pairs(t, keys, sketch_limit):
                some[i] = some[j] = True
            yield pa.RecordBatch.from_arrays([pa.array(t[c].to_numpy()[some]) for c in ("bits", "cid")], names=["bits", "cid"])

    return run


def similar_sets(sets: list[np.ndarray], pairs: Iterator[tuple[np.ndarray, np.ndarray]], least: float) -> Forest:
    """The groups that pairs (i < j) of sets of a Jaccard similarity of `least` or more join; pairs of one group are not looked at again."""
    forest, size = Forest(len(sets)), np.array([len(s) for s in sets], np.int64)
    own = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(size)[:-1])
    marked = np.zeros(sum(map(len, sets)), bool)
    for i, j in pairs:
        able = np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j])
        i, j = i[able], j[able]
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        start = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else []
        for s, e in zip(start, [*start[1:], len(i)]):
            u, v = i[s], j[s:e]
            v = v[forest.label[v] != forest.label[u]]
            marked[own[u]] = True
            both = np.array([np.count_nonzero(marked[own[x]]) for x in v], np.int64)
            marked[own[u]] = False
            hit = v[both / (size[u] + size[v] - both) >= least]
            if len(hit):
                forest.join(np.full(len(hit), u), hit)
    return forest


def _verifier(keys: list[str], sketch_limit: int, k: int, least: float):
    """Edges that connect what the open pairs of each bucket connect by the similarity of their texts: at most one for each row."""

    def run(batches):
        for t in runs_of(batches, keys):
            key = [t[c].to_numpy() for c in keys]
            start = np.flatnonzero(np.append(True, np.logical_or.reduce([x[1:] != x[:-1] for x in key])))
            for s, e in zip(start, [*start[1:], t.num_rows]):
                if e - s < 2:
                    continue
                own = t.slice(s, e - s).combine_chunks()
                words = [x.encode().lower().split() for x in own["text"].to_pylist()]
                label = similar_sets([shingle_set(w, k) for w in words], open_pairs(own, keys, sketch_limit), least).label
                at, cid = np.flatnonzero(label != np.arange(len(label))), own["cid"].to_numpy()
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(cid[at]), pa.array(cid[label[at]])], names=["a", "b"])

    return run


def hamming_edges(fps: DataFrame, limit: int = 4, blocks: int = 6, bucket_rows: int = 4096) -> DataFrame:
    """(a, b): edges that connect just what links of `limit` bits or fewer connect.

    fps has distinct 64-bit words in column fp. Words within `limit` bits agree on at
    least blocks - limit of the blocks, so each word goes to one bucket for every such
    choice of blocks. Each bucket is sorted by Gray rank and searched by `tree_pairs`;
    it gives back at most one edge a word, whatever the number of links. Buckets over `bucket_rows` are cut by a hash of the word into pieces, and
    every two pieces meet in a task of their own, so that no task holds a large bucket
    and no link is lost.
    """
    masks = blocks_of(64, blocks)
    keyed = fps.select(
        "fp",
        F.explode(F.array(*[
            F.struct(F.lit(n).alias("combo"), F.col("fp").bitwiseAND(F.lit(signed(sum(masks[i] for i in c)))).alias("bits"))
            for n, c in enumerate(combinations(range(blocks), blocks - limit))
        ])).alias("k"),
    ).select("fp", "k.combo", "k.bits")
    edges = [_by_bucket(rows, keys, _linker(limit, keys)) for rows, keys in pieced(keyed, ["combo", "bits"], "fp", bucket_rows)]
    return reduce(DataFrame.unionByName, edges).distinct()


def _by_bucket(rows: DataFrame, keys: list[str], search) -> DataFrame:
    dealt = rows.repartition(*keys).withColumn("gray", gray_rank(F.col("fp"))).sortWithinPartitions(*keys, "gray").drop("gray")
    return dealt.mapInArrow(search, "a long, b long")


def simhash_components(docs: DataFrame, k: int = 4, limit: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of docs.

    Fingerprints that differ in `limit` bits or fewer are linked; component_id is the
    smallest doc_id that links reach. Null and wordless texts have fingerprint zero, which
    is linked as any other. Repeated rows each get a row. A null doc_id keeps
    its row and never names a component; a component of none but such rows has null.
    """
    prints = written(docs.select("doc_id", fingerprint_udf(k)("text").alias("fp")))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = component_roots(classes, limit)
    return prints.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def component_roots(classes: DataFrame, limit: int) -> DataFrame:
    """(fp, component_id) of distinct fingerprints with their smallest doc_id (fp, least)."""
    roots = connected_components(hamming_edges(classes.select("fp"), limit))
    at = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return at.join(at.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")


#: Columns of the hash of a text's shingle set, and of its wide fingerprint: the SimHash of the set in 256 bits.
CLASS, SKETCH = ["h0", "h1"], ["s0", "s1", "s2", "s3"]
#: Wide fingerprints meet where they agree in the KEY_BITS bits of one of TABLES choices. At a similarity of 0.8 they differ in 39
#: of 256 bits on average, with a deviation of 6, and one pair in about 2000 never meets.
TABLES, KEY_BITS = 72, 12
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
#: Nearest candidates of a row and bucket that are verified first.
MOST = 1
#: The bits of each table: shuffles of all 256, cut into tables that share none.
CHOICES = np.concatenate([np.random.default_rng([SEED, n]).permutation(256)[: 256 // KEY_BITS * KEY_BITS] for n in range(4)]).reshape(-1, KEY_BITS)[:TABLES]


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(words: list[bytes], k: int) -> np.ndarray:
    """Sorted hashes of the distinct k-shingles of some words."""
    parts = [np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(words[at : at + CHUNK + k - 1], k)], np.uint64)) for at in range(0, max(1, len(words) - k + 1), CHUNK)]
    return np.unique(np.concatenate(parts))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of distinct shingles in four words; the first is that of the hashes themselves, the others of hashes of theirs."""
    votes = np.zeros(256, np.int64)
    for at in range(0, len(hashes), CHUNK):
        h = hashes[at : at + CHUNK]
        words = np.stack([h, *(_mixed(h + m) for m in MIX)], axis=1)
        bits = np.unpackbits(words.astype(">u8").view(np.uint8), axis=1)
        for n in range(0, len(bits), 255):  # sums of 255 bits fit a byte
            votes += bits[n : n + 255].sum(0, dtype=np.uint8)
    return np.packbits(2 * votes > len(hashes)).view(">u8").astype(np.uint64)


def sketch(text: str | None, k: int = 5) -> np.ndarray:
    """CLASS and SKETCH of the text's set of k-shingles, six words; zeros without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(6, np.uint64)
    every = shingle_set(words, k)
    whole = xxhash.xxh3_128_digest(every.tobytes(), SEED)
    return np.concatenate([np.frombuffer(whole, np.uint64), wide_fingerprint(every)])


def bucket_keys(words: np.ndarray) -> np.ndarray:
    """(rows, TABLES) of columns of four words: the number of the table, then the fingerprint's bits that it looks at."""
    bits = np.unpackbits(np.ascontiguousarray(words.T).astype(">u8").view(np.uint8), axis=1)
    out = np.arange(TABLES, dtype=np.int64) << KEY_BITS | np.zeros((len(bits), 1), np.int64)
    for n in range(KEY_BITS):
        out |= bits[:, CHOICES[:, n]].astype(np.int64) << n
    return out


def _sketches(k: int):
    def run(batches):
        for b in batches:
            x = np.array([sketch(t, k) for t in b["text"].to_pylist()], np.uint64).reshape(b.num_rows, 6).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["digest"], *(pa.array(np.ascontiguousarray(x[:, i])) for i in range(6))], names=["doc_id", "digest", *CLASS, *SKETCH])

    return run


def _dealer(batches):
    """Each class once for every table."""
    for b in batches:
        cells = bucket_keys(np.stack([b[c].to_numpy().view(np.uint64) for c in SKETCH]))
        for n in range(TABLES):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(cells[:, n])), b["cid"], *(b[c] for c in SKETCH)], names=["bits", "cid", *SKETCH])


def jaccard_udf(k: int, held: int = 64):
    """Jaccard similarity of the k-shingle sets of two texts; the sets of the last `held` texts are kept as arrays."""

    @F.arrow_udf("double")
    def jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
        known: dict[str, np.ndarray] = {}

        def of(text: str) -> np.ndarray:
            own = known.get(text)
            if own is None:
                if len(known) >= held:
                    del known[next(iter(known))]
                words = text.encode().lower().split()
                own = known[text] = shingle_set(words, k) if words else np.zeros(0, np.uint64)
            return own

        out = []
        for x, y in zip(a, b):
            u, v = of(x.as_py() or ""), of(y.as_py() or "")
            both = len(np.intersect1d(u, v, assume_unique=True))
            out.append(both / (len(u) + len(v) - both) if len(u) or len(v) else 1.0)
        return pa.array(out, pa.float64())

    return jaccard


def _in_gray_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    dealt = rows.repartition(*keys).withColumn("gray", gray_rank(F.col("s0")))
    return dealt.sortWithinPartitions(*keys, "gray", "cid").drop("gray")


def similar_groups(docs: DataFrame, k: int = 5, least: float = 0.8, sketch_limit: int = 70, bucket_rows: int = 4096, text_rows: int = 512) -> DataFrame:
    """(doc_id, digest, root) of every row: a number for each group of texts that links of a Jaccard similarity of `least` or more of their
    k-word shingles connect. digest: a hash of the text, which tells rows of one id apart.

    Candidates are found by SimHash: each shingle set has a fingerprint of 256 bits, which goes to a bucket for every table, by the bits
    that the table looks at. Each bucket is sorted by Gray rank and searched for fingerprints that differ in `sketch_limit` bits or
    fewer, large ones by the tree of `tree_pairs`. The texts' similarity has the last word. First the pairs of `pick_pairs` of
    each row and bucket are verified, so that a group of copies, which its hub joins, gives pairs in proportion to its rows. Then
    every candidate pair that is not yet in one component is verified in the first bucket that it shares: rows with such a pair bring their
    texts there, buckets of more than `text_rows` such rows are cut into pieces that meet pairwise, and a bucket gives at most one
    edge a row. So every candidate pair is verified or lies in one component, and no table holds pairs. Texts of equal
    shingle sets are one class.
    """
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    prints = written(docs.select("doc_id", digest.alias("digest"), "text").mapInArrow(_sketches(k), "doc_id long, digest long, h0 long, h1 long, s0 long, s1 long, s2 long, s3 long"))
    classes = written(prints.groupBy(*CLASS).agg(F.min(F.struct("doc_id", "digest")).alias("least"), *(F.min(c).alias(c) for c in SKETCH)).withColumn("cid", F.monotonically_increasing_id()))
    # texts without words are one class, and meet no other
    keyed = classes.where("h0 <> 0 or h1 <> 0").select("cid", *SKETCH).mapInArrow(_dealer, "bits long, cid long, s0 long, s1 long, s2 long, s3 long")
    found = [_in_gray_order(rows, keys).mapInArrow(_picker(keys, sketch_limit, MOST), "bits long, cid long, other long") for rows, keys in pieced(keyed, ["bits"], "cid", bucket_rows)]
    found = written(reduce(DataFrame.unionByName, found))
    pairs = written(found.select(F.least("cid", "other").alias("a"), F.greatest("cid", "other").alias("b")).distinct())
    live = written(found.select("bits", "cid").distinct().join(classes.select("cid", *SKETCH), "cid"))
    # texts of the classes that meet others, once for both passes
    named = classes.join(live.select("cid").distinct(), "cid").select("cid", F.coalesce("least.doc_id", F.lit(0)).alias("_id"), F.col("least.doc_id").isNull().alias("_none"), F.col("least.digest").alias("_digest"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), digest.alias("_digest"), "text")
    live_texts = written(rows.join(named, ["_id", "_none", "_digest"]).groupBy("cid").agg(F.first("text").alias("text")))
    x, y = (live_texts.select(F.col("cid").alias(c), F.col("text").alias(f"text_{c}")) for c in ("a", "b"))
    roots = connected_components(pairs.join(x, "a").join(y, "b").where(jaccard_udf(k)("text_a", "text_b") >= least).select("a", "b"))
    now = live.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    split = now.groupBy("bits").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bits")
    now = written(now.join(split, "bits"))
    marks = [_in_gray_order(rows, keys).mapInArrow(_marker(keys, sketch_limit), "bits long, cid long") for rows, keys in pieced(now, ["bits"], "cid", bucket_rows)]
    marks = written(reduce(DataFrame.unionByName, marks).distinct())
    edges = [
        _in_gray_order(rows.join(now, ["bits", "cid"]).join(live_texts, "cid"), keys).mapInArrow(_verifier(keys, sketch_limit, k, least), "a long, b long")
        for rows, keys in pieced(marks, ["bits"], "cid", text_rows)
    ]
    edges = written(reduce(DataFrame.unionByName, edges))
    if not edges.isEmpty():
        roots = connected_components(edges.unionByName(roots.toDF("a", "b")))
    named = classes.join(roots, classes.cid == roots.node, "left").select(*CLASS, F.coalesce("root", "cid").alias("root"))
    return prints.join(named, CLASS).select("doc_id", "digest", "root")


def similar_components(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, component_id) of every row by `similar_groups`; component_id is the group's smallest id, null if it has none."""
    rows = written(similar_groups(docs, **options))
    return rows.join(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def without_copies(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each group of `similar_groups`, and all its columns: the one of the smallest id, null ids last.

    Rows of one id with texts of different groups stay each; of rows alike in id and text one stays. Texts without words are alike, so one
    of them stays. A group's choice is an aggregate with partial sums, and rows are dropped by a join with those that are not
    chosen, so that a group may hold most rows.
    """
    rows = written(similar_groups(docs, **options))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    # a group with one distinct row needs no choice
    groups = rows.groupBy("root").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("rows")).where("rows > 1")
    groups = written(groups)
    key = ["_id", "_none", "_digest"]
    named = rows.select("root", F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.col("digest").alias("_digest"))
    kept = groups.select("root", F.coalesce("first.doc_id", F.lit(0)).alias("_id"), F.col("first.none").alias("_none"), F.col("first.digest").alias("_digest"))
    split = groups.where("first <> last").select("root")
    dropped = written(named.join(split, "root", "left_semi").join(kept, ["root", *key], "left_anti").select(*key).distinct())
    again = written(named.join(kept, ["root", *key], "left_semi").groupBy(*key).count().where("count > 1").select(*key))
    row = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_digest"))
    row = row.join(dropped, key, "left_anti")
    if not again.isEmpty():
        once = row.join(again, key, "left_semi").groupBy(*key).agg(F.first("row").alias("row"))
        row = row.join(again, key, "left_anti").select("row").unionByName(once.select("row"))
    return row.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
