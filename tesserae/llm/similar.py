"""Groups of similar documents by SimHash and pivot distance tables: every pair whose five-word shingles have a Jaccard similarity of 0.8.

Search. A document's fingerprint is the majority of its shingles' hash bits, in words of 64 bits. Every word is tabulated as in simhash.py: for
each pair of its four blocks, the Hamming distances of the kept bits to PIVOTS reference fingerprints are a bucket's key, so texts
meet if any word of theirs differs in two bits at most, and mostly at more. Pairs that meet are discarded by the maximum coordinate difference of
their full distances to the pivots, by the parities of their shingles' classes and by the Hamming distance of the whole fingerprints; survivors are verified by the
exact similarity of their sets, and links make components.

Rest. Texts at the threshold differ in up to 15 % of their bits, too many to meet surely under a bearable number of tables. So that no link
between two components is lost, an exact search follows the tables: of two sets of
n and m shingles of that similarity, the first n - ceil(0.8 n) + 1 and m - ceil(0.8 m) + 1 in any common order have one in common.
The order puts shingles first that are rare in the whole table by COUNTERS counters (of a fixed size, so they can be broadcast; how exact
they are changes the cost, never the result). Of the buckets of such shingles, those that lie within one component are done with. Pairs of the others are
discarded by the sizes of their sets and their places in them and by the same filters, and verified. Sets of up to SHORT shingles are
not judged by fingerprints. FAR is 5.8 standard deviations above the distance at the threshold, so that filter loses a pair in
10^8; all others lose none.

Disk. Keys are dealt by arrays of numbers, not by rows; only those of two texts or more come back as rows. Texts are never dealt as a whole: a filter of a few bits
for each row that is looked for tells the rows that are, and a few others, before the exact join.

Exact copies are collapsed first; a text is named by its hash. Buckets of up to BUCKET documents are joined pair by pair. A fuller bucket is dealt at random in
parts of that size, and its links put its documents in components; documents of different components are dealt once more. What that leaves is
compared in blocks of BLOCK by BLOCK: all pairs of documents in different components. So near copies by the thousand cost a few
comparisons each, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, drop_written, small_batches, tidy, unused, written
from .simhash import PIVOTS, masks, pivots

SHINGLE = 5
#: Similarity as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
BITS = 256
#: Bits that similar documents differ in at most; the similarity decides. Sets of up to SHORT shingles are not held to it.
FAR, SHORT = 72, 40
#: Counters of shingles, the chunks that they are added up in, and the parts of a chunk that are added up first.
COUNTERS, CHUNKS, PARTS = 1 << 20, 16, 8
#: Rows that are joined pair by pair, and rows of one block of a full bucket.
BUCKET, BLOCK = 8, 512
#: Keys of one part that they are dealt in, and rows of one batch of what comes back.
PART_KEYS, PART_ROWS = 1 << 21, 1 << 16
#: Bits of the filter for each row that is looked for, bits of the whole filter at most, and bits set by a row.
SIEVE, SIEVE_BITS, SIEVE_HASHES = 16, 1 << 27, 3
_WORDS = BITS // 64
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_CHUNK = 1 << 14


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted hashes of the distinct SHINGLE-word shingles of each text; fewer words make one shingle, none makes none."""
    words, counts = [], []
    for t in texts:
        own = (t or "").encode("utf-8", "surrogatepass").lower().split()
        words += own
        counts.append(len(own))
    if not words:
        return [np.empty(0, np.uint64) for _ in texts]
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))[codes]
    full = max(len(h) - SHINGLE + 1, 0)
    grams = np.zeros(full, np.uint64)
    for k in range(SHINGLE):
        grams = _mixed((grams ^ h[k : k + full]) * _MIX[k])
    out, at = [], 0
    for n in counts:
        if n >= SHINGLE:
            out.append(np.unique(grams[at : at + n - SHINGLE + 1]))
        else:
            one = np.full(min(n, 1), n, np.uint64)
            for k in range(n):
                one = _mixed((one ^ h[at + k]) * _MIX[k])
            out.append(one)
        at += n
    return out


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """The majority bits of the shingles' hashes."""
    counts = np.zeros(BITS, np.int64)
    for a in range(0, len(shingles), _CHUNK):
        part = shingles[a : a + _CHUNK]
        wide = np.stack([_mixed(part * _MIX[k] + np.uint64(k)) for k in range(_WORDS)], axis=1)
        bits = np.unpackbits(wide.view(np.uint8), axis=1)
        for b in range(0, len(part), 255):  # no sum of so few bits passes 255
            counts += np.add.reduce(bits[b : b + 255], axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(shingles)).view(np.uint64)


def prefix_length(n: int) -> int:
    """How many of n ordered shingles a similar set must share one of."""
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def _pivot_words() -> np.ndarray:
    return np.array([x & (1 << 64) - 1 for x in pivots(PIVOTS * _WORDS, seed=11)], np.uint64).reshape(PIVOTS, _WORDS)


def distances(fp: np.ndarray) -> np.ndarray:
    """Distances of fingerprints, of a row each, to the pivots; a byte each, 255 for more."""
    apart = fp[:, None, :] ^ _pivot_words()[None]
    return np.minimum(np.bitwise_count(apart).sum(axis=2, dtype=np.int64), 255).astype(np.uint8)


def table_keys(fp: np.ndarray) -> np.ndarray:
    """Keys of fingerprints, of a row each: hashes of the distances to the pivots over the kept bits, for every word and pair of blocks."""
    reference, out = np.array([x & (1 << 64) - 1 for x in pivots()], np.uint64), []
    for w in range(_WORDS):
        apart = fp[:, w, None] ^ reference
        for mask in masks():
            near = np.bitwise_count(apart & np.uint64(mask & (1 << 64) - 1)).astype(np.uint8).view(np.uint64)
            key = np.full(len(fp), len(out), np.uint64)
            for k in range(PIVOTS // 8):
                key = _mixed((key ^ near[:, k]) * _MIX[k])
            out.append(key)
    return np.stack(out, axis=1)


def _fs() -> list[str]:
    return [f"f{i}" for i in range(_WORDS)]


def _ps() -> list[str]:
    return [f"p{i}" for i in range(PIVOTS // 8)]


def _xs() -> list[str]:
    return [f"x{i}" for i in range(_WORDS)]


def parities(shingles: np.ndarray) -> np.ndarray:
    """BITS bits, each the parity of the number of shingles of its class. Two sets differ in no fewer shingles than these in bits."""
    bits = np.bincount((_mixed(shingles) % np.uint64(BITS)).astype(np.int64), minlength=BITS) % 2
    return np.packbits(bits.astype(bool)).view(np.uint64)


def _counter(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _hashes() -> list[Column]:
    return [F.xxhash64(_text()), F.xxhash64(_text(), F.lit(1))]


def rarity(docs: DataFrame) -> np.ndarray:
    """How often shingles of each of COUNTERS classes occur in docs (text). Only the counters leave the tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for b in batches:
            counts += np.bincount(_counter(np.concatenate(shingle_sets(b.column(0).to_pylist()))), minlength=COUNTERS)
        part = TaskContext.get().partitionId() % PARTS
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS)), pa.array([part] * CHUNKS), pa.array([x.tobytes() for x in counts.reshape(CHUNKS, -1)], pa.binary())], names=names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, raw in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(raw, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([0] * len(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=names)

    names, schema = ["chunk", "part", "counts"], "chunk long, part long, counts binary"
    small_batches(docs.sparkSession)
    parts = docs.select(_text()).mapInArrow(tidy(count), schema)
    sums = parts.repartition("chunk", "part").mapInArrow(add, schema).repartition("chunk").mapInArrow(add, schema)
    out = np.zeros((CHUNKS, COUNTERS // CHUNKS), np.int64)
    for r in sums.collect():  # CHUNKS rows, whatever the table's size
        out[r.chunk] = np.frombuffer(r.counts, np.int64)
    return np.minimum(out.ravel(), (1 << 32) - 1).astype(np.uint32)


def _features(docs: DataFrame) -> DataFrame:
    """(id, h1, h2, n, keys, fingerprint f0..., distances to the pivots p0...): n shingles, of which the text meets others under keys."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(rarity(docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), *_hashes(), _text())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = shared.value
        for b in batches:
            sets = shingle_sets(b.column(3).to_pylist())
            fp = np.array([fingerprint(s) for s in sets], np.uint64).reshape(-1, _WORDS)
            odd = np.array([parities(s) for s in sets], np.uint64).reshape(-1, _WORDS)
            numbers = np.concatenate([fp.view(np.int64), distances(fp).view(np.int64), odd.view(np.int64)], axis=1)
            # texts without a word meet each other under zero
            keys = [s[np.lexsort((s, rare[_counter(s)]))[: prefix_length(len(s))]].view(np.int64) if len(s) else np.zeros(1, np.int64) for s in sets]
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], n, pa.array(keys, pa.list_(pa.int64())), *(pa.array(np.ascontiguousarray(x)) for x in numbers.T)], names=["id", "h1", "h2", "n", "keys", *_fs(), *_ps(), *_xs()])

    longs = lambda names: ", ".join(f"{c} long" for c in names)
    return rows.mapInArrow(tidy(run), f"{longs(['id', 'h1', 'h2', 'n'])}, keys array<long>, {longs([*_fs(), *_ps(), *_xs()])}")


def _near(a: str, b: str) -> Column:
    """The sizes and places of two bucket rows allow the similarity, and neither a pivot coordinate nor the Hamming distance differs by more than FAR."""
    n, at = ([F.col(f"{s}.{c}") for s in (a, b)] for c in ("n", "at"))
    common = F.least(n[0] - at[0], n[1] - at[1])  # where this is the first shingle that they have in common
    fits = (common * (NUMERATOR + DENOMINATOR) >= (n[0] + n[1]) * NUMERATOR) & (F.least(*n) * DENOMINATOR >= F.greatest(*n) * NUMERATOR)
    near = F.lit(True)
    for p in _ps():
        for j in range(8):
            x, y = (F.shiftright(F.col(f"{s}.{p}"), 8 * j).bitwiseAND(F.lit(255)) for s in (a, b))
            near = near & (F.abs(x - y) <= FAR)
    apart = lambda names: sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in names), F.lit(0))
    parity = apart(_xs()) * (NUMERATOR + DENOMINATOR) <= (n[0] + n[1]) * (DENOMINATOR - NUMERATOR)
    return fits & parity & ((F.least(*n) <= SHORT) | (near & (apart(_fs()) <= FAR)))


def _meet(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs (u, v) of bucket rows that meet in this turn, lie in different components and pass the filters.

    A bucket of more than BUCKET rows is dealt at random in parts of about BUCKET, anew in every bucket and turn.
    """
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("node", "key", F.lit(turn)), F.ceil(F.col("size") / BUCKET)))
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.label") != F.col("b.label"))
    return dealt.alias("a").join(dealt.alias("b"), met & _near("a", "b")).select(F.col("b.node").alias("u"), F.col("a.node").alias("v")).distinct()


def _shared(rows: DataFrame) -> DataFrame:
    """(table, node, key, at, size): texts that meet others under a key of the tables (table true) or of their first shingles, and how many meet there.

    Keys are dealt as arrays, a row for each part of a batch; a part has PART_KEYS keys or the session's share of them, if that is less.
    """
    total = rows.agg(F.sum(F.size("keys") + _WORDS * len(masks()))).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_KEYS))
    fields = ["part", "table", "key", "node", "at"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, n = b.column(0).to_numpy(), pc.list_value_length(b.column(1)).to_numpy()
            keys = table_keys(np.stack([c.to_numpy().view(np.uint64) for c in b.columns[2:]], axis=1))
            first = np.repeat(np.cumsum(n) - n, n)
            for is_table, key, own, at in (
                (True, keys.ravel(), np.repeat(node, keys.shape[1]), np.zeros(keys.size, np.uint16)),
                (False, b.column(1).flatten().to_numpy().view(np.uint64), np.repeat(node, n), np.minimum(np.arange(n.sum()) - first, (1 << 16) - 1).astype(np.uint16)),
            ):
                part = ((_mixed(key) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                order, ends = np.argsort(part, kind="stable"), np.cumsum(np.bincount(part, minlength=parts))
                found = np.flatnonzero(np.diff(ends, prepend=0))
                cut = lambda x: pa.array([x[order[a:z]].tobytes() for a, z in zip(np.r_[0, ends][found], ends[found], strict=True)], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([is_table] * len(found), pa.bool_()), cut(key), cut(own), cut(at)], names=fields)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {True: [], False: []}
        for b in batches:
            for is_table, *raw in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                held[is_table].append(raw)
        for is_table, raws in held.items():
            key, node, at = (np.frombuffer(b"".join(r[i] for r in raws), t) for i, t in enumerate((np.int64, np.int64, np.uint16)))
            order = np.lexsort((node, key))
            key, node, at = key[order], node[order], at[order]
            new = np.ones(len(key), bool)  # copies of a text have the same keys
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, node, at = key[new], node[new], at[new]
            size = np.unique_counts(key).counts
            size = np.repeat(size, size)
            key, node, at, size = (x[size > 1].astype(np.int64) for x in (key, node, at, size))
            for a in range(0, len(key), PART_ROWS):
                one = [x[a : a + PART_ROWS] for x in (node, key, at, size)]
                yield pa.RecordBatch.from_arrays([pa.array([is_table] * len(one[0]), pa.bool_()), *map(pa.array, one)], names=["table", "node", "key", "at", "size"])

    dealt = rows.select("h1", "keys", *_fs()).mapInArrow(tidy(deal), "part long, table boolean, key binary, node binary, at binary")
    return dealt.repartitionById(parts, F.col("part").cast("int")).mapInArrow(tidy(meet), "table boolean, node long, key long, at long, size long")


def _places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for k in range(SIEVE_HASHES):
        yield (_mixed(keys.view(np.uint64) * _MIX[k] + np.uint64(k)) & np.uint64(bits - 1)).astype(np.int64)


def sieve(keys: DataFrame) -> Callable[[Column], Column]:
    """Of the first column of keys (bigint): a test that all of its numbers pass, and few others."""
    bits = min(max(1 << (SIEVE * keys.count()).bit_length(), 1 << 10), SIEVE_BITS)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.zeros(bits, bool)
        for b in batches:
            for at in _places(b.column(0).to_numpy(), bits):
                marked[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(marked).tobytes()], pa.binary())], names=["marked"])

    both = np.zeros(bits // 8, np.uint8)
    for r in keys.repartition(4).mapInArrow(mark, "marked binary").collect():  # of SIEVE_BITS at most
        both |= np.frombuffer(r.marked, np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(both)

    def passes(x: pd.Series) -> pd.Series:
        out = np.ones(len(x), bool)
        for at in _places(x.to_numpy(np.int64), bits):
            out &= (shared.value[at >> 3] >> (7 - (at & 7))) & 1 == 1
        return pd.Series(out)

    return F.pandas_udf(passes, "boolean")


def _sets(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, set): hashes of the shingles of the texts of pairs (u, v) of nodes (node, id). Of the copies of a text, the one of the least id is read."""
    ends = pairs.select("u").union(pairs.select("v")).distinct().withColumnRenamed("u", "end")
    ends = written(ends.join(nodes.select("node", "id"), F.col("end") == F.col("node")).select("end", F.xxhash64("node", "id").alias("place")), "similar-ends")
    rows = docs.select(_hashes()[0].alias("node"), F.col("doc_id").cast("long").alias("id"), _text().alias("text"))
    rows = rows.where(sieve(ends.select("place"))(F.xxhash64("node", "id"))).groupBy("node").agg(F.first("text").alias("text"))
    rows = rows.join(ends, F.col("node") == F.col("end")).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s.view(np.int64) for s in shingle_sets(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    out = written(rows.mapInArrow(tidy(run), "node long, set array<long>"), "similar-sets")
    drop_written(ends)
    return out


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the distinct pairs (u, v) whose sets are similar; two empty sets are. Each pair's sets are joined with it once."""
    sets = _sets(docs, nodes, pairs)
    s = lambda x: sets.select(F.col("node").alias(f"n_{x}"), F.col("set").alias(f"s_{x}"))
    both = pairs.join(s("u"), F.col("u") == F.col("n_u")).join(s("v"), F.col("v") == F.col("n_v"))
    common = F.size(F.array_intersect("s_u", "s_v"))
    total = F.size("s_u") + F.size("s_v") - common
    out = written(both.where(common * DENOMINATOR >= total * NUMERATOR).select("u", "v"), "similar-links")
    drop_written(pairs)
    drop_written(sets)
    return out


def _mixed_buckets(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component, with their label."""
    named = roots.select(F.col("node").alias("m"), "root")
    labelled = rows.join(named, F.col("node") == F.col("m"), "left").withColumn("label", F.coalesce("root", "node")).drop("m", "root")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select(F.col("key").alias("k"))
    return labelled.join(mixed, F.col("key") == F.col("k")).drop("k")


def _all_pairs(mixed: DataFrame) -> DataFrame:
    """All pairs (u, v) of these bucket rows that lie in different components and pass the filters, found in blocks of BLOCK by BLOCK."""
    left = mixed.withColumn("blocks", F.ceil(F.col("size") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    columns = ["key", "node", "label", "n", "at", *_fs(), *_ps(), *_xs()]
    low = F.explode(F.sequence(F.lit(0).cast("long"), F.col("block"))).alias("i")
    high = F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j")
    one, other = left.select(*columns, F.col("block").alias("i"), high).alias("a"), left.select(*columns, low, F.col("block").alias("j")).alias("b")
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
    once = (F.col("a.i") < F.col("a.j")) | (F.col("a.node") < F.col("b.node"))
    pairs = one.join(other, met & once & (F.col("a.label") != F.col("b.label")) & _near("a", "b"))
    return pairs.select(F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v")).distinct()


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, h1, h2) of every row of docs (doc_id, text), and (id, h1, h2, node, root) of every distinct text.

    h1 and h2 are the text's hashes, id the least doc_id of the text (null if it has none), root names the group of similar texts. Null texts
    count as empty, and texts without a word are similar to each other only. Other columns are not read.
    """
    features = written(_features(docs), "similar-features")
    numbers = ["n", *_fs(), *_ps(), *_xs()]
    nodes = features.groupBy(F.col("h1").alias("node")).agg(F.min("id").alias("id"), F.min("h2").alias("h2"), F.max("h2").alias("other"), *(F.first(c).alias(c) for c in numbers))
    nodes = written(nodes, "similar-nodes")
    if nodes.where("h2 <> other").take(1):  # one chance in 10^5 at 15 million texts
        raise ValueError("two texts have one hash of 64 bits")
    rows = written(features.select("id", "h1", "h2"), "similar-ids")
    shared = written(_shared(features), "similar-shared")
    drop_written(features)
    numbered = nodes.select(F.col("node").alias("m"), *numbers)
    full = lambda df: df.join(numbered, F.col("node") == F.col("m")).drop("m")
    met = full(shared.where("table").drop("table")).withColumn("label", F.col("node"))
    links = _verified(docs, nodes, written(_meet(met, 0), "similar-pairs"))
    roots = connected_components(links)
    rest = written(full(_mixed_buckets(shared.where("not table").drop("table"), roots)), "similar-rest")
    drop_written(shared)
    hot, left = rest.where(F.col("size") > BUCKET).drop("label"), rest
    for meet in (lambda rows: _meet(rows, 1), lambda rows: _meet(rows, 2), _all_pairs):
        if left is None:
            left = written(_mixed_buckets(hot, roots), "similar-mixed")
        if not left.take(1):
            break
        more = _verified(docs, nodes, written(meet(left), "similar-pairs"))
        if left is not rest:
            drop_written(left)
        left = None
        if more.take(1):
            links = written(links.union(more), "similar-links")
            roots = connected_components(links)
    done = nodes.join(roots.select(F.col("node").alias("m"), "root"), F.col("node") == F.col("m"), "left").select("id", F.col("node").alias("h1"), "h2", "node", F.coalesce("root", "node").alias("root"))
    done = written(done, "similar-groups")
    drop_written(rest)
    drop_written(nodes)
    return rows, done


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each group: the one of the least doc_id. All columns stay.

    Rows of one doc_id but different texts are different documents; of repeated rows of one doc_id and text one stays, of texts
    that share their group's least doc_id the one of the least hash. Documents without an id stay where their group has none
    with an id, in the place of one. An empty table stays empty; other columns are not read, and may have any name.
    """
    rows, found = groups(docs)
    nameless, named = F.col("id").isNull(), F.coalesce("id", F.lit(0))
    best = found.groupBy("root").agg(F.min(F.struct(nameless.alias("nameless"), named.alias("named"), "h1", "h2")).alias("b")).select("b.*")
    best = written(best, "similar-best")
    own = ["nameless", "named", "h1", "h2"]
    every = rows.select(nameless.alias("nameless"), named.alias("named"), "h1", "h2").groupBy(*own).agg(F.count("*").alias("times"))
    every = written(every, "similar-rows")
    gone = written(every.join(best, own, "left_anti").select(*own), "similar-gone")
    again = written(every.where("times > 1").join(best, own, "left_semi").select(*own), "similar-again")
    names = unused(docs, *own)
    doc_id = F.col("doc_id").cast("long")
    marked = docs.withColumns(dict(zip(names, [doc_id.isNull(), F.coalesce(doc_id, F.lit(0)), *_hashes()], strict=True)))
    as_marked = lambda df: df.toDF(*names)
    perhaps = sieve(gone.union(again).select(F.xxhash64("named", "h1")))(F.xxhash64(names[1], names[2]))
    kept = marked.where(perhaps).join(as_marked(gone), names, "left_anti")
    if again.take(1):
        once = kept.join(as_marked(again), names, "left_semi").dropDuplicates(names)
        kept = kept.join(as_marked(again), names, "left_anti").unionByName(once)
    return marked.where(~perhaps).drop(*names).unionByName(kept.drop(*names))
