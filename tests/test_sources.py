import numpy as np
import pytest

from tesserae.sources import curves, png, y4m

RGB = np.random.default_rng(5).integers(0, 256, (9, 13, 3)).astype(float)


def test_png(tmp_path, spark):
    assert (png.read(png.write(RGB)) == RGB).all()
    ten = RGB * 4
    assert (png.read(png.write(ten, 10)) >> 6 == ten).all()
    for i in range(3):
        (tmp_path / f"f{i:04d}.png").write_bytes(png.write(RGB + i))
    got = png.images(spark, f"file://{tmp_path}/*.png").orderBy("frame_idx").collect()
    assert [r.frame_idx for r in got] == [0, 1, 2] and np.allclose(np.array(got[0].rgb).reshape(RGB.shape), RGB)
    with pytest.raises(ValueError):
        png.read(png.write(RGB)[:40] + b"x" + png.write(RGB)[41:])


def test_png_filters():
    """Lines under every filter, made by hand."""
    import struct
    import zlib

    raw = RGB.astype(np.uint8).reshape(9, 39)
    lines = []
    for y in range(9):
        kind, line, up = y % 5, raw[y].astype(int), raw[y - 1].astype(int) if y else np.zeros(39, int)
        left, corner = np.concatenate([[0] * 3, line[:-3]]), np.concatenate([[0] * 3, up[:-3]])
        p = left + up - corner
        d = [abs(p - left), abs(p - up), abs(p - corner)]
        paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], up, corner))
        lines.append(bytes([kind]) + ((line - (0, left, up, (left + up) // 2, paeth)[kind]) % 256).astype(np.uint8).tobytes())
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    data = png.MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", 13, 9, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
    assert (png.read(data) == RGB).all()


def test_y4m(tmp_path, spark):
    grey = [np.full((7, 9, 3), 20.0 * i) for i in range(5)]
    path = tmp_path / "a.y4m"
    path.write_bytes(b"".join(y4m.write(iter(grey), 9, 7, (25, 2))))
    h = y4m.header(path.read_bytes()[:200])
    assert (h.width, h.height, h.fps_num, h.fps_den) == (9, 7, 25, 2)
    spark.dataSource.register(y4m.Y4m)
    got = spark.read.format("y4m").option("framesPerTask", 2).load(str(path)).orderBy("frame_idx").collect()
    assert [r.frame_idx for r in got] == list(range(5))
    assert np.allclose(got[3].rgb, np.clip(1.164 * (60 - 16), 0, 255))
    assert y4m.window([1, 2, 3], 1, 4) == [2, 3, 3, 3]


def test_curves(tmp_path, spark):
    (tmp_path / "c.csv").write_text("q,psnr,bpp\n2,40,3\n1,30.5,1\n3,inf,9\n")
    path = f"file://{tmp_path}/c.csv"
    assert [r.psnr for r in curves.curve(spark, path).collect()] == [30.5, 40.0, float("inf")]
    (tmp_path / "d.csv").write_text("q,psnr\n1,2\n")
    assert curves.points(spark, f"file://{tmp_path}/d.csv").count() == 0
    with pytest.raises(ValueError):
        curves.curve(spark, f"file://{tmp_path}/d.csv")
    js = spark.createDataFrame([('{"pooled_metrics": {"vmaf": {"mean": 91.5, "min": 80, "max": 99}}}',)], "value string")
    assert tuple(curves.pooled_score(js).first()) == (91.5, 80.0, 99.0)
    frames = spark.createDataFrame([(0, "I", 40.0, 0.9, 1.0, 100), (1, "P", 42.0, 0.8, 0.5, 50)], "frame_idx int, frame_type string, psnr double, ssim double, bpp double, encoded_bytes long")
    curves.write_sequence(frames, f"file://{tmp_path}/s")
    assert spark.read.csv(f"file://{tmp_path}/s", header=True).where("frame_idx = 'summary' and encoded_bytes = 150").count() == 1
