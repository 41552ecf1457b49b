"""SimHash near-dedup with pivot distance tables.

A document's fingerprint is the majority of the XXH64 bits of its word shingles. Fingerprints of at most two
differing bits are linked; components of links are the groups of near duplicates.

Search. Distinct fingerprints only (copies share one row). The 64 bits are four blocks of 16; two fingerprints of at
most two differing bits agree on two whole blocks at least. For each of the six pairs of blocks, the Hamming
distances of the kept bits to PIVOTS reference fingerprints are tabulated; equal bits give equal distances, so
linked fingerprints meet in one bucket of equal distance vectors at least. In a bucket, pairs whose full distance
vectors differ by more than two in any coordinate are discarded (triangle inequality), and survivors are verified by
the Hamming distance. Buckets of more than BUCKET fingerprints would make too many pairs: their members take an exact
linear way, in which every fingerprint meets the 64 fingerprints one bit away; two fingerprints within two bits always
share one of those, and any two that share one are within two bits, so a star per shared value keeps all links'
components. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, small_batches, table, tidy, written

SHINGLE = 3
SEED = 42
MAX_BITS = 2
PIVOTS = 16
#: Fingerprints of one bucket that are compared pair by pair.
BUCKET = 64
_CHUNK = 1 << 15


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of one text; 0 if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < size:
        return h(b" ".join(words), seed)
    n = len(words) - size + 1
    counts = np.zeros(64, np.int64)
    for a in range(0, n, _CHUNK):
        part = words[a : a + _CHUNK + size - 1]
        values = np.array([h(b" ".join(x), seed) for x in zip(*(part[i:] for i in range(size)), strict=False)], dtype=">u8")
        counts += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp bigint: the fingerprint's bits as a signed number), one row per row of docs; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), size, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, fp long")


def pivots(n: int = PIVOTS, seed: int = 1) -> list[int]:
    """Reference fingerprints: consecutive outputs of the splitmix64 generator, as signed numbers."""
    out, x, full = [], seed, (1 << 64) - 1
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & full
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & full
        z ^= z >> 31
        out.append(z - (1 << 64) if z >> 63 else z)
    return out


def _distances(fp: Column, mask: int | None = None) -> list[Column]:
    """Distances to the pivots over the bits of mask, eight of them packed in a bigint."""
    packs = []
    for a in range(0, PIVOTS, 8):
        pack = F.lit(0).cast("long")
        for j, p in enumerate(pivots()[a : a + 8]):
            x = fp.bitwiseXOR(F.lit(p).cast("long"))
            if mask is not None:
                x = x.bitwiseAND(F.lit(mask).cast("long"))
            pack = pack.bitwiseOR(F.shiftleft(F.bit_count(x).cast("long"), 8 * j))
        packs.append(pack)
    return packs


def masks() -> list[int]:
    """The bits of each pair of blocks, as signed numbers."""
    blocks = [0xFFFF << (16 * i) for i in range(4)]
    both = [blocks[i] | blocks[j] for i in range(4) for j in range(i + 1, 4)]
    return [m - (1 << 64) if m >> 63 else m for m in both]


def _near(a: str, b: str) -> Column:
    """No coordinate of the pivot tables differs by more than MAX_BITS."""
    out = F.lit(True)
    for k in range(PIVOTS // 8):
        for j in range(8):
            x, y = (F.shiftright(F.col(f"{s}.p{k}"), 8 * j).bitwiseAND(F.lit(255)) for s in (a, b))
            out = out & (F.abs(x - y) <= MAX_BITS)
    return out


def links(distinct_fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) whose components are those of all pairs within MAX_BITS bits."""
    fp = F.col("fp")
    p0, p1 = _distances(fp)
    rows = distinct_fps.select("fp", p0.alias("p0"), p1.alias("p1")).select(
        "fp", "p0", "p1", F.explode(F.array(*(F.struct(F.lit(i).alias("m"), _distances(fp, m)[0].alias("k0"), _distances(fp, m)[1].alias("k1")) for i, m in enumerate(masks())))).alias("b")
    ).select("fp", "p0", "p1", F.col("b.m").alias("m"), F.col("b.k0").alias("k0"), F.col("b.k1").alias("k1"))
    keys = ["m", "k0", "k1"]
    several = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    met = written(rows.join(several, keys), "simhash-buckets")
    cold = met.where(F.col("n") <= bucket)
    a, b = cold.alias("a"), cold.alias("b")
    same = (F.col("a.m") == F.col("b.m")) & (F.col("a.k0") == F.col("b.k0")) & (F.col("a.k1") == F.col("b.k1"))
    close = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MAX_BITS
    pairs = a.join(b, same & (F.col("a.fp") < F.col("b.fp")) & _near("a", "b") & close).select(F.col("b.fp").alias("u"), F.col("a.fp").alias("v"))
    bits = [1 << i for i in range(63)] + [-(1 << 63)]
    around = F.array(fp, *(fp.bitwiseXOR(F.lit(x).cast("long")) for x in bits))
    stars = met.where(F.col("n") > bucket).select("fp").distinct().select("fp", F.explode(around).alias("near"))
    least = stars.groupBy("near").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select("near", "v")
    return pairs.union(stars.join(least, "near").where("fp <> v").select(F.col("fp").alias("u"), "v"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of docs.

    fingerprint: 16 lowercase hex digits. component_id: the smallest doc_id reachable over links, itself included. Null
    and empty texts have fingerprint zero and are linked like any other; rows with a null doc_id take part and get
    the component of their fingerprint, null if no row of it has an id. Repeated rows each come back. Other columns
    of docs are not read. An empty table gives an empty result.
    """
    fps = written(fingerprints(docs), "simhash")
    distinct_fps = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = connected_components(links(distinct_fps.select("fp")))
    linked = written(distinct_fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = linked.join(ids, "root").select(F.col("fp").alias("f"), "component_id")
    return fps.join(classes, F.col("fp") == F.col("f")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
