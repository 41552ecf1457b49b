"""Identities, monotonic quality, damage and containers, over synthetic images."""

from dataclasses import replace

import numpy as np
import pytest

from tesserae.operators import codec, containers, transforms

H, W = 80, 100
y, x = np.mgrid[:H, :W]
GRADIENT = np.stack([np.round(255 * x / W), np.round(255 * y / H), np.round(255 * (x + y) / (W + H))], -1)
_noise = np.random.default_rng(42).integers(-10, 11, (H, W, 1))
CHECKER = np.rint(np.clip(np.where(((x // 32 + y // 32) % 2)[..., None], 200.0, 55.0) + _noise, 0, 255) * [1, 0.9, 0.8])


@pytest.mark.parametrize("image", [GRADIENT, CHECKER])
def test_lossless_at_100(image):
    assert (codec.decode_frame(codec.encode_frame(image, codec.settings(100, W, H, 64))) == image).all()


def test_quality_rises():
    got = [codec.psnr(CHECKER, codec.decode_frame(codec.encode_frame(CHECKER, codec.settings(q, W, H, 64)))) for q in (10, 25, 50, 75, 90)]
    assert all(b >= a - 0.5 for a, b in zip(got, got[1:], strict=False)) and got[-1] > 45


@pytest.mark.parametrize("more", [{"coder": c} for c in ("rans", "rans_bands", "huffman", "bitplane", "rice")] + [{"chroma": "422"}, {"chroma": "420"}, {"block_dct": True}])
def test_variants(more):
    assert codec.psnr(GRADIENT, codec.decode_frame(codec.encode_frame(GRADIENT, codec.settings(75, W, H, 64, **more)))) > 38


def test_damage_is_found_and_replaced():
    blob = bytearray(codec.encode_frame(CHECKER, codec.settings(75, W, H, 64)))
    blob[-5] ^= 255
    _, valid = containers.read_frame(bytes(blob))
    assert valid.count(False) == 1
    assert codec.decode_frame(bytes(blob)).shape == CHECKER.shape


def test_predicted_frames():
    frames = [np.roll(CHECKER, 2 * i, 1) for i in range(4)]
    blobs = codec.encode_group(frames, codec.settings(75, W, H, 64))
    assert [containers.read_frame(b)[0].kind for b in blobs] == ["I", "P", "P", "P"]
    for a, b in zip(frames, codec.decode_group(blobs), strict=True):
        assert codec.psnr(a, b) > 40


def test_frames_between():
    frames = [np.roll(CHECKER, i, 1) for i in range(9)]
    blobs = codec.encode_pyramid(frames, codec.settings(75, W, H, 64))
    assert [containers.read_frame(b)[0].kind for b in blobs] == ["I", *"BBBBBBB", "P"]
    assert containers.read_frame(blobs[3])[0].refs == (2, 4)
    for a, b in zip(frames, codec.decode_pyramid(blobs), strict=True):
        assert codec.psnr(a, b) > 36


@pytest.mark.parametrize("n", [1, 5, 10, 20])
def test_groups_within_any_interval(n):
    frames = [np.roll(CHECKER, i, 1) for i in range(n)]
    blobs = codec.encode_pyramid(frames, codec.settings(75, W, H, 64))
    kinds = "".join(containers.read_frame(b)[0].kind for b in blobs)
    assert kinds == "I" + "BBBBBBBP" * ((n - 1) // 8) + "P" * ((n - 1) % 8)
    for a, b in zip(frames, codec.decode_pyramid(blobs), strict=True):
        assert codec.psnr(a, b) > 34


def test_damage_between():
    """A damaged tile of a frame between two others loses its residual and nothing else."""
    frames = [np.roll(CHECKER, i, 1) for i in range(9)]
    blobs = codec.encode_pyramid(frames, codec.settings(75, W, H, 64))
    whole = codec.decode_pyramid(blobs)
    blobs[1] = blobs[1][:-1] + bytes([blobs[1][-1] ^ 255])
    assert not all(containers.read_frame(blobs[1])[1])
    got = codec.decode_pyramid(blobs)
    assert all((a == b).all() for i, (a, b) in enumerate(zip(whole, got, strict=True)) if i != 1)
    assert np.isfinite(got[1]).all()


def test_sequences_decode(spark):
    rows = [(7, i, W, H, np.roll(CHECKER, i, 1).astype(float).ravel().tolist()) for i in range(12)]
    df = spark.createDataFrame(rows, "seq_id long, frame_idx long, width int, height int, rgb array<double>")
    coded = codec.encode_sequences(df, q=75, interval=10, tile=64).cache()
    back = {r.frame_idx: np.rint(np.array(r.rgb)) for r in codec.decode_sequences(coded, interval=10).collect()}
    assert sorted(back) == list(range(12))
    for r in coded.collect():
        assert codec.psnr(np.array(rows[r.frame_idx][4]), back[r.frame_idx]) == pytest.approx(r.psnr)
    assert sorted(r.frame_idx for r in codec.decode_sequences(coded.where("frame_idx <> 0"), interval=10).collect()) == [10, 11]


def test_intra_inverts():
    from tesserae.operators import intra

    for plane in (CHECKER[:64, :96, 0], GRADIENT[:64, :96, 2], np.zeros((32, 32))):
        residual, modes = intra.predict(plane)
        assert np.abs(intra.reconstruct(residual, modes) - plane).max() < 1e-9


@pytest.mark.parametrize("coder", ["rans", "rans_bands", "huffman", "bitplane"])
def test_first_layout(coder):
    """A frame of the first layout, made from a new one by leaving out what it lacks."""
    f = codec.encode_planes(codec.color(CHECKER, False), codec.settings(75, W, H, 64, coder=coder))
    new = containers.write_frame(f)
    behind = len(new) - sum(map(len, f.tiles)) - 8 * len(f.tiles) - 8
    old = b"GPC8" + new[4:34] + new[36 : behind - 2] + new[behind : behind + 8] + b"".join(f.tiles)
    assert containers.read_frame(old)[0].tiles == f.tiles


def test_sweeps(spark):
    from tesserae.operators import sweeps

    frames = spark.createDataFrame([(0, 0, W, H, CHECKER.ravel().tolist())], "seq_id long, frame_idx long, width int, height int, rgb array<double>")
    got = {r.settings: r for r in sweeps.run(frames, "dead_zone", 64).collect()}
    assert len(got) == 10
    assert got['{"dead_zone": 0.0, "step": 4.0}'].psnr > got['{"dead_zone": 1.0, "step": 8.0}'].psnr
    assert sweeps.throughput(lambda: codec.encode_frame(CHECKER, codec.settings(50, W, H, 64)), W * H, 1)["fps"] > 0


def test_frame_fields_come_back():
    f = containers.Frame(
        64, 64, tile=32, step=3.5, levels=2, weights=[1.0, 1.5, 1.5, 2.0, 1.0, 1.0, 1.25], kind="B", block=16, vectors=[(i - 8, 3 * i % 7 - 3) if i % 3 else (0, 0) for i in range(16)],
        back_vectors=[(0, 0)] * 8 + [(-300, 5)] * 8, modes=[i % 3 for i in range(16)], refs=(2, 3), alphas=[5] * 2 * 7 * 4, aq=True, aq_strength=0.25, weight_map=[1.0, 0.5], intra_modes=[1, 2, 3, 0, 1], tiles=[b"abc", b""],
    )
    got, valid = containers.read_frame(containers.write_frame(f))
    assert got == f and all(valid)


def test_sequence_files(spark):
    blobs = [(bytes([i]) * (i + 1), "IPPIP"[i]) for i in range(5)]
    data = containers.write_sequence(blobs, 8, 6, (30000, 1001))
    head, index = containers.sequence_index(data)
    assert head["frames"] == 5 and [data[o : o + n] for _, o, n, _, _ in index] == [b for b, _ in blobs]
    df = containers.index_frame(spark, data)
    assert [containers.seek_keyframe(df, p) for p in (0, 2, 3, 99)] == [0, 0, 3, 3]
    made = spark.createDataFrame([(i, k, b) for i, (b, k) in enumerate(blobs)], "pts long, kind string, blob binary")
    assert [r.offset for r in containers.index_of_blobs(made).orderBy("pts").collect()] == [o for _, o, _, _, _ in index]


def test_temporal_files(spark):
    groups = [{"gop": g, "low": b"L%d" % g, "highs": [[b"f0", b"f1"], [b"deep"]]} for g in (0, 2)]
    data = containers.write_temporal(groups, [(4, b"t4"), (12, b"t12")], 8, 6, 13, (25, 1), "haar", 4, 2.0)
    head, rows = containers.temporal_index(data)
    assert head["transform"] == "haar" and [data[r[1] : r[1] + r[2]] for r in rows] == [b"L0", b"deep", b"f0", b"f1", b"L2", b"deep", b"f0", b"f1", b"t4", b"t12"]
    df = containers.index_frame(spark, data)
    assert [r.gop for r in containers.groups_of(df).collect()] == [0, 2]
    assert [r.level for r in containers.group_entries(df, 2).collect()] == [0, 1, 0, 0]
    assert [r.pts for r in containers.tail_of(df).collect()] == [4, 12]


@pytest.mark.parametrize("kind", ["5/3", "9/7"])
def test_wavelets_invert(kind):
    t = np.rint(np.random.default_rng(3).normal(0, 50, (2, 32, 32)))
    back = transforms.unwavelet(transforms.wavelet(t, 3, kind), 3, kind)
    assert (back == t).all() if kind == "5/3" else np.abs(back - t).max() < 1e-9
    line = lambda v: transforms._lift53(np.array([v], float))[0].tolist()
    assert line(range(8)) == [0, 2, 4, 6, 0, 0, 0, 1]
    assert line([10, 20, 15, 5, 0, 255, 100, 50]) == [14, 17, 51, 139, 8, -2, 205, -50]


@pytest.mark.parametrize("name,n", [("dct8", 8), ("dct16", 16), ("hadamard4", 4), ("haar16", 16), ("haar16x2", 16)])
def test_block_transforms_invert(spark, name, n):
    from pyspark.sql import functions as F

    v = np.random.default_rng(1).normal(0, 10, n * n).round(3).tolist()
    df = spark.createDataFrame([(v,)], "a array<double>")
    t = df.withColumn("c", transforms.block_transform(name, F.col("a")))
    r = t.select("c", transforms.block_transform(name, F.col("c"), True).alias("b")).first()
    assert np.allclose(r.b, v) and np.isclose(np.square(r.c).sum(), np.square(v).sum())


def test_frames_over_dataframes(spark):
    rows = [(s, i, W, H, np.roll(GRADIENT, i, 1).ravel().tolist()) for s in (1, 2) for i in range(5)]
    frames = spark.createDataFrame(rows, "seq_id long, frame_idx long, width int, height int, rgb array<double>")
    coded = codec.encode(frames, 75, 64)
    assert coded.where("psnr > 38").count() == 10
    assert codec.decode(coded).count() == 10
    assert codec.tile_bytes(coded).where("not valid").count() == 0
    assert {r.kind for r in codec.encode_sequences(frames, 75, 4, 64).collect()} == {"I", "P"}
    back = {(r.seq_id, r.frame_idx): np.array(r.rgb).reshape(H, W, 3) for r in codec.decode_temporal(codec.encode_temporal(frames, 90, 4, 64), 4).collect()}
    assert len(back) == 10
    assert all(codec.psnr(np.array(r[4]).reshape(H, W, 3), back[r[0], r[1]]) > 35 for r in rows)


def test_settings_follow_the_table():
    f = codec.settings(80, W, H)
    assert (round(f.step, 4), f.levels, f.wavelet) == (3.3466, 4, "9/7")
    assert codec.lossless(replace(f, step=1.0, dead_zone=0.0, wavelet="5/3"))


def test_queries_cover_every_frame(spark, sf_dir):
    from tesserae.operators import containers
    from tesserae.plans import codecs

    want = {(r.seq_id, r.frame_idx) for r in codecs.frames(spark, sf_dir).collect()}
    index = codecs.container_index(spark, sf_dir).collect()
    assert {(r.seq_id, r.pts) for r in index} == want and len(index) == len(want)
    for seq in {s for s, _ in want}:
        own = sorted((r.pts, r.offset, r.size) for r in index if r.seq_id == seq)
        at = containers.SEQUENCE_HEADER + containers.SEQUENCE_ENTRY * len(own)
        for _, offset, size in own:
            assert offset == at
            at += size
    coded = codecs.codec_pyramid(spark, sf_dir).collect()
    assert {(r.seq_id, r.frame_idx) for r in coded} == want and len(coded) == len(want)


def test_frames_hold_every_block(spark, sf_dir):
    from tesserae.plans import codecs

    vectors = {}
    for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect():
        vectors.setdefault(r.label, []).append(np.floor(np.abs(np.array(r.embedding, float) * 100) + 0.5) * np.sign(r.embedding) + 128)
    got = {(r.seq_id, r.frame_idx): np.array(r.rgb).reshape(32, 32, 3)[:, :, 0] for r in codecs.frames(spark, sf_dir).collect()}
    assert set(got) == {(s, f) for s, own in vectors.items() for f in range(-(-len(own) // 16))}
    for (s, f), plane in got.items():
        for k in range(16):
            want = vectors[s][min(16 * f + k, len(vectors[s]) - 1)].reshape(8, 8)
            assert (plane[k // 4 * 8 : k // 4 * 8 + 8, k % 4 * 8 : k % 4 * 8 + 8] == want).all()
