"""Embedding near-dedup by lattice hashing.

Equal vectors are collapsed first. In each of TABLES tables a vector is projected at random to two groups of eight
dimensions, and each group is decoded to its nearest point of the E8 lattice; the two points name the cell. A vector
stands in its own cell and looks into that and the neighbouring cells whose lattice points lie nearest, PROBES in either
group. Vectors that meet are verified by their cosine in double precision.

Pairs whose signs on 64 random directions differ in more than SIGNS are discarded before their vectors are fetched (a pair at
the threshold differs in 6.5 on average; beyond SIGNS with a probability under 1e-7), in sparse and in full cells alike.

Cells with up to CELL vectors that stand or look in are joined pair by pair. Fuller cells are compared in blocks of
BLOCK by BLOCK vectors, one task each: only counts of links and one link to a representative for each
vector and block leave it, so neither all pairs of a group nor an unbounded group is ever held. A pair that meets in
several such cells counts in the least of them.

Recall is measured in the tests against brute force (over 0.99 at the threshold with these parameters).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, table, tidy, written

THRESHOLD = 0.95
TABLES, PROBES, SCALE, SEED = 6, 4, 0.3, 7
CELL, BLOCK, SIGNS = 128, 512, 22
#: Products of blocks this far below the threshold are computed again, as pairs of sparse cells are.
_NEAR = 1e-9


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest point of D8: integers of even sum."""
    f = np.floor(x + 0.5)
    d = x - f
    odd = np.nonzero(f.sum(axis=1) % 2)[0]
    k = np.abs(d[odd]).argmax(axis=1)
    f[odd, k] += np.where(d[odd, k] >= 0, 1, -1)
    return f


def e8(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8, which is D8 and D8 moved by one half."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, which lead to the neighbouring points."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


class Tables:
    """The projections for one number of dimensions."""

    def __init__(self, dims: int):
        rng = np.random.default_rng([SEED, dims])
        self.parts = []
        for _ in range(TABLES):
            g = rng.normal(size=(dims, 16))
            q = np.linalg.qr(g)[0] if dims >= 16 else g / np.linalg.norm(g, axis=0) * np.sqrt(min(1.0, 16 / dims))
            # SCALE suits 64 dimensions; a difference shrinks with the square root of the share kept
            self.parts.append((q * np.sqrt(dims / 64) / SCALE, rng.uniform(size=16)))
        self.weights = rng.integers(1, 1 << 62, size=(TABLES, 16), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.near = minimal_vectors()
        self.directions = rng.normal(size=(dims, 64))
        self.dims = dims

    def signs(self, unit: np.ndarray) -> np.ndarray:
        """Which side of each random direction the vectors lie on, as bits of a number."""
        return np.packbits(unit @ self.directions > 0, axis=1).view(np.int64).ravel()

    def _key(self, t: int, point: np.ndarray, half: int) -> np.ndarray:
        twice = np.rint(2 * point).astype(np.int64).astype(np.uint64)
        return (twice * self.weights[t, 8 * half : 8 * half + 8]).sum(axis=1, dtype=np.uint64)

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the cell of each vector by table, and of the cells it looks into besides by table."""
        home, looks = [], []
        for t, (q, offset) in enumerate(self.parts):
            y = unit @ q + offset
            keys, probes = [], []
            for half in (0, 1):
                x = y[:, 8 * half : 8 * half + 8]
                c = e8(x)
                keys.append(self._key(t, c, half))
                away = ((x - c) ** 2).sum(axis=1)[:, None] - 2 * (x - c) @ self.near.T  # and a constant
                best = np.argpartition(away, PROBES, axis=1)[:, :PROBES]
                probes.append(np.stack([self._key(t, c + self.near[best[:, k]], half) for k in range(PROBES)], axis=1))
            salt = np.uint64((t + 1) * 0x9E3779B97F4A7C15 + self.dims & (1 << 64) - 1)
            mix = lambda a, b: (_mixed(a) ^ (_mixed(b + salt) * np.uint64(0xC2B2AE3D27D4EB4F))) + salt
            home.append(mix(keys[0], keys[1]))
            looks.append(np.concatenate([mix(probes[0], keys[1][:, None]), mix(keys[0][:, None], probes[1])], axis=1))
        return np.stack(home, axis=1).view(np.int64), np.concatenate(looks, axis=1).view(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def _units(vectors: pa.Array) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of unit vectors, of a row each; each is the same whatever rows stand beside it, and whichever of the two is first."""
    return (x * y).sum(axis=1)


def hashed(reps: DataFrame) -> DataFrame:
    """(rep, cell, home, signs): the cells in which each vector of reps (rep, dims, vec) stands (home) or looks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, Tables] = {}
        for b in batches:
            dims = b.column(1).to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                own = b.filter(pa.array(dims == d))
                t = tables.setdefault(int(d), Tables(int(d)))
                unit = _units(own.column(2))
                (home, looks), signs = t.cells(unit), t.signs(unit)
                rep = own.column(0).to_numpy(zero_copy_only=False)
                n, p = home.shape[1], looks.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([np.repeat(rep, n), np.repeat(rep, p)])),
                        pa.array(np.concatenate([home.ravel(), looks.ravel()])),
                        pa.array(np.arange(len(rep) * (n + p)) < len(rep) * n),
                        pa.array(np.concatenate([np.repeat(signs, n), np.repeat(signs, p)])),
                    ],
                    names=["rep", "cell", "home", "signs"],
                )

    return reps.select("rep", "dims", "vec").mapInArrow(tidy(run), "rep long, cell long, home boolean, signs long")


def _similar(pairs: DataFrame) -> DataFrame:
    """Rows of (a, b, m_a, m_b, vec_a, vec_b) whose cosine reaches the threshold, without the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(4), b.column(5)
            same = pa.compute.equal(pa.compute.list_value_length(x), pa.compute.list_value_length(y)).to_numpy(zero_copy_only=False)
            lens = pa.compute.list_value_length(x).to_numpy(zero_copy_only=False)
            ok = np.zeros(b.num_rows, bool)
            for d in np.unique(lens[same]):
                at = np.nonzero(same & (lens == d))[0]
                take = pa.array(at)
                ok[at] = _cosine(_units(x.take(take)), _units(y.take(take))) >= THRESHOLD
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(ok)) for i in range(4)], names=["a", "b", "m_a", "m_b"])

    return pairs.select("a", "b", "m_a", "m_b", "vec_a", "vec_b").mapInArrow(tidy(run), "a long, b long, m_a long, m_b long")


def _compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One block of a full cell: links counted for each vector, and links that join the same vectors."""
    cell, stand, look = int(key[0]), rows[rows["stands"]], rows[~rows["stands"]]
    if stand.empty or look.empty:
        return pd.DataFrame({"rep": [], "n": [], "other": []}, dtype="int64")
    unit = lambda df: _units(pa.array(df["vec"].tolist(), pa.list_(pa.float64())))
    u, v = unit(look), unit(stand)
    i, j = np.nonzero(u @ v.T >= THRESHOLD - _NEAR)
    like = np.bitwise_count(look["signs"].to_numpy(np.int64)[i] ^ stand["signs"].to_numpy(np.int64)[j]) <= SIGNS
    i, j = i[like], j[like]
    exact = np.concatenate([_cosine(u[i[n : n + BLOCK]], v[j[n : n + BLOCK]]) for n in range(0, len(i), BLOCK)] or [np.empty(0)]) >= THRESHOLD
    i, j = i[exact], j[exact]
    a, b = look["rep"].to_numpy()[i], stand["rep"].to_numpy()[j]
    ok = a != b
    i, j, a, b = i[ok], j[ok], a[ok], b[ok]
    home_a, home_b = look["hot_home"].map(set).tolist(), stand["hot_home"].map(set).tolist()
    in_a, in_b = look["hot_in"].map(set).tolist(), stand["hot_in"].map(set).tolist()
    keep = np.zeros(len(i), bool)
    for n, (p, q) in enumerate(zip(i, j, strict=True)):
        met = (in_a[p] & home_b[q]) | (in_b[q] & home_a[p])
        # where both stand, the pair meets both ways: then the smaller vector looks
        keep[n] = min(met) == cell and (cell not in home_a[p] or a[n] < b[n])
    i, j, a, b = i[keep], j[keep], a[keep], b[keep]
    m_a, m_b = look["m"].to_numpy()[i], stand["m"].to_numpy()[j]
    counts = pd.DataFrame({"rep": np.concatenate([a, b]), "n": np.concatenate([m_b, m_a])}).groupby("rep", as_index=False)["n"].sum()
    # a spanning forest of the block's links keeps its components
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            up[max(p, q)] = min(p, q)
    counts["other"] = [root(int(x)) for x in counts["rep"]]
    return counts[["rep", "n", "other"]].astype("int64")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of vectors (vec_id, embedding).

    Links: cosine of THRESHOLD or more in double precision, whatever other columns say. Vectors that are null, empty,
    zero or hold null or non-finite components, and rows with a null vec_id, link with nothing: n_links 0,
    component_id their vec_id. Vectors of different length link with nothing of each other. Repeated rows count as
    other vectors. Other columns are not read; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    good = "vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)"
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vec")).withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))
    v = v.withColumn("ok", F.coalesce(F.expr(good.replace("embedding", "vec")), F.lit(False)))
    reps = written(v.where("ok").groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")).select("rep", "m", F.size("vec").alias("dims"), "vec"), "vectors")
    cells = written(hashed(reps).distinct(), "cells")
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).where("n > 1 and homes > 0").select(F.col("cell").alias("c"), "n")
    met = written(cells.join(sizes, F.col("cell") == F.col("c")).select("rep", "cell", "home", "signs", "n"), "met-cells")
    hot = met.where(F.col("n") > CELL)
    of_hot = written(
        hot.groupBy("rep").agg(F.collect_set(F.when(F.col("home"), F.col("cell"))).alias("hot_home"), F.collect_set("cell").alias("hot_in")), "hot-cells"
    )
    full = reps.join(of_hot.withColumnRenamed("rep", "r"), F.col("rep") == F.col("r"), "left").select(
        "rep", "m", "vec", *(F.coalesce(c, F.array().cast("array<long>")).alias(c) for c in ("hot_home", "hot_in"))
    )

    # sparse cells: candidate pairs, each once, then the vectors of both
    cold = met.where(F.col("n") <= CELL)
    stand = cold.where("home").select("cell", F.col("rep").alias("y"), F.col("signs").alias("s_y"))
    look = cold.select("cell", F.col("rep").alias("x"), F.col("signs").alias("s_x"))
    like = F.bit_count(F.col("s_x").bitwiseXOR(F.col("s_y"))) <= SIGNS
    pairs = look.join(stand, "cell").where((F.col("x") != F.col("y")) & like).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    side = lambda s: full.select(F.col("rep").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("m", "vec", "hot_home", "hot_in")))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    elsewhere = F.arrays_overlap("hot_home_a", "hot_in_b") | F.arrays_overlap("hot_in_a", "hot_home_b")
    links = written(_similar(both.where(~elsewhere)), "links")

    # full cells: blocks of those that stand against blocks of those that look or stand
    dealt = hot.withColumn("block", F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / BLOCK))).withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    dealt = dealt.join(full.withColumnRenamed("rep", "r"), F.col("rep") == F.col("r")).drop("r")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    stands = dealt.where("home").withColumn("sb", F.col("block")).withColumn("lb", every)
    looks = dealt.withColumn("lb", F.col("block")).withColumn("sb", every)
    columns = ["cell", "sb", "lb", "rep", "signs", "m", "vec", "hot_home", "hot_in"]
    meets = stands.select(*columns, F.lit(True).alias("stands")).unionAll(looks.select(*columns, F.lit(False).alias("stands")))
    dense = written(meets.groupBy("cell", "sb", "lb").applyInPandas(_compare, "rep long, n long, other long"), "dense-links")

    counts = (
        links.select(F.col("a").alias("rep"), F.col("m_b").alias("n"))
        .unionAll(links.select(F.col("b").alias("rep"), F.col("m_a").alias("n")))
        .unionAll(dense.select("rep", "n"))
        .groupBy("rep")
        .agg(F.sum("n").alias("n"))
        .withColumnRenamed("rep", "r1")
    )
    roots = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(dense.select(F.col("rep").alias("u"), F.col("other").alias("v"))))
    done = (
        reps.join(counts, F.col("rep") == F.col("r1"), "left")
        .join(roots, F.col("rep") == F.col("node"), "left")
        .select(F.col("vec").alias("same"), F.coalesce("n", F.lit(0)).alias("n"), "m", F.coalesce("root", "rep").alias("root"))
    )
    key = F.when(F.col("ok"), F.col("vec"))
    return v.join(done, key == F.col("same"), "left").select(
        "vec_id",
        F.coalesce(F.col("n") + F.col("m") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("root", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("root", "vec_id")).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
