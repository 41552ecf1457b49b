from pyspark.sql import functions as F

from tesserae.streaming import rate


def test_stream_equals_batch(spark, tmp_path):
    schema = "seq_id long, pos long, complexity double"
    rows = [(s, i, 0.5 + (i * 7 + s) % 5) for s in (1, 2, 3) for i in range(12)]
    df = spark.createDataFrame(rows, schema)
    for i, part in enumerate((df.where("pos < 6"), df.where("pos >= 6"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/b={i}")
    src = spark.readStream.schema(schema + ", b int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").drop("b")
    q = rate.controlled(src, 3e6, 30.0, 100_000).writeStream.format("memory").queryName("steps").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    key = lambda r: (r.seq_id, r.pos, round(r.step, 9), round(r.fill, 3))
    got = sorted(map(key, spark.table("steps").collect()))
    assert len(got) == 36
    assert {(a, b) for a, b, *_ in got} == {(a, b) for a, b, _ in rows}
    assert got == sorted(map(key, rate.controlled_batch(df, 3e6, 30.0, 100_000).collect()))


def test_scene_stream(spark, tmp_path):
    schema = "seq_id long, pos long, value double"
    df = spark.createDataFrame([(1, i, float(100 * (i // 4))) for i in range(12)], schema)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = rate.scene_cuts(src).writeStream.format("memory").queryName("cuts").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.table("cuts").orderBy("pos").collect()
    assert [r.segment for r in got] == [i // 4 for i in range(12)] and sum(r.cut for r in got) == 2


def test_running_groups(spark, tmp_path):
    schema = "seq_id long, pos long, bits long"
    spark.createDataFrame([(1, i, 10) for i in range(10)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = rate.grouped_rates(src, 4).writeStream.format("memory").queryName("rates").outputMode("complete").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [(r.gop, r.frames, r.bits) for r in spark.table("rates").orderBy(F.col("gop")).collect()] == [(0, 4, 40), (1, 4, 40), (2, 2, 20)]


def test_steep_fits_keep_the_model(spark):
    """Steps that hardly differ give slopes whose constant passes the largest double; such a fit is dropped, as in the reference."""
    rows = [(1, i, (24.0, 21.3, 7.8)[i // 31]) for i in range(93)]
    got = rate.controlled_batch(spark.createDataFrame(rows, "seq_id long, pos long, complexity double"), 3e6, 30.0, 100_000).collect()
    assert len(got) == 93 and all(0.5 <= r.step <= 128 and 0 <= r.fill <= 6e6 for r in got)
    c = rate.Controller(3e6, 30.0, 100_000)
    for step, bpp in ((4.0, 1.0), (4.00004, 0.1)):
        before = c.alpha
        c.update(step, bpp)
    assert c.alpha == before == 1.2 and c.c == 4.0**1.2
    assert rate.Controller(3e6, 30.0, 100_000, c=1e40, alpha=0.11).step() == 128
