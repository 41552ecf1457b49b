import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import bits, config, geometry, quant, samples
from tesserae.operators import entropy, lifting, matching, planes, quality
from tesserae.operators.rate import Controller


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("v")).first().v


def test_quantiser(spark):
    df = spark.createDataFrame([(2.9,), (3.0,), (-6.0,), (10.0,), (-1.0,)], "v double")
    assert [r.q for r in df.select(quant.quantize(F.col("v"), 4.0, 0.75).alias("q")).collect()] == [0, 1, -2, 3, 0]


def test_colour(spark):
    c = [F.lit(float(v)) for v in (200, 100, 50)]
    assert [one(spark, v) for v in samples.ycocg_forward(*c, True)] == [112, 150, -25]
    assert [one(spark, v) for v in samples.ycocg_forward(*c, False)] == [112.5, 150, -25]
    assert [one(spark, v) for v in samples.ycocg_forward(*(F.lit(float(v)) for v in (0, 255, 1)), True)] == [127, -1, 255]
    assert [one(spark, v) for v in samples.unpack_i16(samples.pack_i16(F.lit(-5.0), F.lit(70000.0)))] == [-5, 32767]
    assert [one(spark, v) for v in samples.unpack(samples.pack([F.lit(float(v)) for v in (1, 300, -4, 9.6)], 8), 8, 4)] == [1, 255, 0, 10]


def test_codes(spark):
    for v, u in ((0, 0), (-1, 1), (1, 2), (-2, 3), (-3, 5), (32767, 65534), (-32768, 65535)):
        assert one(spark, bits.zigzag(F.lit(v))) == u
        assert one(spark, bits.unzigzag(F.lit(u).cast("long"))) == v
    for total, count, k in ((0, 0, 0), (1, 2, 0), (9, 1, 3), (15, 2, 2), (33, 2, 4), (1 << 20, 1, 15)):
        assert one(spark, bits.rice_k(F.lit(total), F.lit(count))) == k


def test_energy_and_weights(spark):
    for e, m in ((0.5, 2.0), (math.sqrt(5), 1.6), (5.0, 1.385103), (10.0, 1.2)):
        assert one(spark, quant.energy_multiplier(F.lit(e), 2.0)) == pytest.approx(m, abs=1e-6)
    for v, w in ((0.0, 1.24), (255.0, 1.0), (65535.0, 0.76)):
        assert one(spark, quant.adaptive_weight(F.lit(v), 0.2)) == pytest.approx(w, abs=1e-3)


def test_presets(spark):
    table = {r.q: r for r in config.preset_table(spark).collect()}
    for q in range(1, 101):
        p = config.quality_preset(q)
        assert table[q].step == pytest.approx(p["step"]) and table[q].cfl == p["cfl"] and table[q].levels == p["levels"]
    assert [round(table[q].step, 4) for q in (20, 40, 80, 90)] == [20.1587, 10.5561, 3.3466, 2.241]
    assert config.packed_weights(config.subband_weights(3, "perceptual"))[:7] == [1.0, 1.0, 1.0, 1.5, 1.5, 1.5, 2.0]


def test_parsers(spark):
    for s, v in (("10M", 1e7), ("2.5k", 2500.0), ("7", 7.0), ("x", None), ("3T", None)):
        assert one(spark, config.bitrate(F.lit(s))) == v
    assert one(spark, config.chroma_kind(F.lit("YUV4:2:0"))) == "420"
    assert one(spark, config.wavelet_kind(F.lit("97"))) == "9/7"
    assert config.csv_name("a/b.csv", "_x") == "a/b_x.csv" and config.csv_name("b", "_x") == "b_x"


def test_geometry(spark):
    g = geometry.frame_geometry(1920, 1080, 256, "420")
    assert (g["tiles_x"], g["tiles_y"], g["chroma_tiles_x"], g["chroma_tiles_y"]) == (8, 5, 4, 3)
    points = ((0, 0), (2, 0), (0, 2), (3, 3), (5, 0), (0, 5), (5, 5))
    assert [one(spark, geometry.subband_index(F.lit(x), F.lit(y), 8, 2)) for x, y in points] == [0, 5, 4, 6, 2, 1, 3]
    assert [one(spark, geometry.subband_group(F.lit(x), F.lit(y), 8, 2)) for x, y in points] == [0, 1, 1, 1, 2, 2, 3]
    assert [one(spark, c) for c in geometry.ll_block(F.lit(63), F.lit(32), 64, 2, 4)] == [3, 0]


def test_temporal_identities(spark):
    f = [F.lit(float(v)) for v in (1, 2, 3, 4)]
    bands = lifting.temporal53(*f)
    assert [one(spark, b) for b in bands] == [0, 1, 1, 3.25]
    assert [one(spark, b) for b in lifting.untemporal53(*bands)] == [1, 2, 3, 4]
    a = F.array(*(F.lit(float(v)) for v in (3, 1, 4, 1, 5, 9, 2, 6)))
    assert one(spark, lifting.unhaar_levels(lifting.haar_levels(a, 8), 8)) == [3, 1, 4, 1, 5, 9, 2, 6]


@pytest.mark.parametrize("level", ["53", "97"])
def test_window_lifting_inverts(spark, level):
    rows = [(k, i, float((i * 37 + k) % 51)) for k in (1, 2) for i in range(20)]
    pairs = lifting.split_pairs(spark.createDataFrame(rows, "k int, pos long, value double"), ["k"])
    fwd, inv = (getattr(lifting, f"{n}{level}") for n in ("forward", "inverse"))
    bands = fwd(pairs, ["k"]).select("k", "n", "low", "high", F.col("even").alias("e"), F.col("odd").alias("o"))
    for r in inv(bands, ["k"]).collect():
        assert r.even == pytest.approx(r.e, abs=1e-6) and r.odd == pytest.approx(r.o, abs=1e-6)


def test_spread_normalisation(spark):
    from tesserae.operators.coders.rans import normalize

    for counts in ([5, 1, 1, 900, 3], [1] * 300, [10_000, 1, 1], [7] * 3 + [1] * 4000):
        df = spark.createDataFrame([(0, i, n) for i, n in enumerate(counts)], "g int, symbol long, n long")
        got = [r.freq for r in entropy.normalize_spread(df, ["g"]).orderBy("symbol").collect()]
        assert got == normalize(np.array(counts)).tolist()


def test_block_match_finds_the_move(spark):
    rng = np.random.default_rng(2)
    plane = rng.integers(0, 255, (24, 24)).astype(float)
    rows = lambda p: spark.createDataFrame([(1, x, y, float(p[y, x])) for y in range(p.shape[0]) for x in range(p.shape[1])], "k int, x long, y long, v double")
    cur = rows(np.roll(plane, (-2, 1), (0, 1))[:16, 8:16])
    cur = cur.withColumn("x", F.col("x") + 8)
    best = matching.block_match(cur, rows(plane), ["k"], 8, matching.moves(3)).collect()
    assert {(r.dx, r.dy, r.sad) for r in best} == {(-1, 2, 0.0)}


def test_planes(spark):
    df = spark.createDataFrame([(x, y, float(10 * y + x)) for x in range(5) for y in range(3)], "x long, y long, v double")
    wide = planes.pad(df, 5, 3, 4)
    got = {(r.x, r.y): r.v for r in wide.collect()}
    assert len(got) == 32 and got[7, 3] == 24 and got[7, 0] == 4
    assert planes.crop(wide, 5, 3).count() == 15
    tiles = planes.to_tiles(planes.tile_place(wide.withColumn("k", F.lit(1)), 4, 2), ["k"], 4)
    assert {(r.x, r.y): r.v for r in planes.from_tiles(tiles, ["k"], 4, 2).collect()} == got


def test_bd_rate():
    bpp, psnr = [0.5, 1.0, 2.0, 4.0, 8.0], [30, 33, 36, 40, 44]
    assert quality.bd_rate(bpp, psnr, bpp, psnr) == pytest.approx(0)
    assert quality.bd_rate(bpp, psnr, [b * 1.1 for b in bpp], psnr) == pytest.approx(10)
    assert quality.bd_psnr(bpp, psnr, bpp, [p + 1 for p in psnr]) == pytest.approx(1)
    assert quality.bd_rate(bpp[:3], psnr[:3], bpp, psnr) is None
    assert quality.bd_rate([*bpp, 9.0], [*psnr, math.inf], bpp, psnr) == pytest.approx(0)


def test_controller():
    c = Controller(0.5 * 30 * 1000, 30, 1000)
    assert c.step() == pytest.approx(3.950658, abs=1e-6)
    for i in range(40):
        c.update(2.0 + i % 5, 4.0 / (2.0 + i % 5))
    assert c.alpha == pytest.approx(1.0) and c.c == pytest.approx(4.0) and len(c.history) == 30
    full = Controller(50.0, 10, 10, "cbr", fill=50.0)
    assert full.step() < Controller(50.0, 10, 10, "cbr").step()


def test_hadamard_covers_every_sample(spark, sf_dir):
    from tesserae.plans import catalogue, registry

    got = catalogue.QUERIES["hadamard4_plane"](spark, sf_dir)
    assert got.count() == got.select("vec_id", "bx", "by", "x", "y").distinct().count() == registry.samples(spark, sf_dir).count()


def test_every_slot_is_looked_up(spark, sf_dir):
    from tesserae.plans import catalogue

    slots = catalogue.QUERIES["symbol_of_every_slot"](spark, sf_dir).groupBy("label", "grp").agg(F.countDistinct("slot").alias("n"), F.count("*").alias("rows")).collect()
    assert {(r.n, r.rows) for r in slots} == {(4096, 4096)}


def test_nearest_of_all_blocks(spark, sf_dir):
    from tesserae.plans import catalogue, registry

    b = {r.vec_id: np.array(r.a) for r in registry.blocks(spark, sf_dir).collect()}
    got = {r.vec_id: r.sad for r in catalogue.QUERIES["block_match_nearest"](spark, sf_dir).collect()}
    want = {i: min(np.abs(a - b[j]).sum() for j in b if j != i) for i, a in b.items() if i % 20 == 0}
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], abs=1e-5) for i in want)


def test_two_stage_query_equals_brute_force(spark, sf_dir):
    from tesserae.plans import catalogue, codecs

    frames = {(r.seq_id, r.frame_idx): np.array(r.rgb).reshape(32, 32, 3)[:, :, 0] for r in codecs.frames(spark, sf_dir).collect()}
    got = {(r.seq_id, r.frame_idx, r.by, r.bx): (r.dx, r.dy, r.sad) for r in catalogue.QUERIES["block_match_two_stage"](spark, sf_dir).collect()}
    assert set(got) == {(s, f, i, j) for s, f in frames if f for i in range(4) for j in range(4)}

    def best(cur, ref, x, y, moves, step, bias):
        costs = []
        for dx, dy in moves:
            if 0 <= x + dx and 0 <= y + dy and x + dx + 8 <= 32 + (step - 1) and y + dy + 8 <= 32 + (step - 1):
                a, b = cur[y : y + 8 : step, x : x + 8 : step], ref[y + dy : y + dy + 8 : step, x + dx : x + dx + 8 : step]
                if a.shape == b.shape:
                    sad = np.abs(a - b).sum()
                    costs.append((sad - (bias if dx == dy == 0 else 0), abs(dx) + abs(dy), dy, dx, sad))
        return min(costs)

    for (s, f, i, j), (dx, dy, sad) in got.items():
        cur, ref = frames[s, f], frames[s, f - 1]
        *_, sy, sx, _ = best(cur, ref, 8 * j, 8 * i, matching.moves(24, 4), 4, 0.0)
        *_, wy, wx, want = best(cur, ref, 8 * j, 8 * i, [(sx + a, sy + b) for a, b in matching.moves(4)], 1, 16.0)
        assert (dx, dy, sad) == (wx, wy, want)
