"""Queries whose results SQL gives though their bytes it can't: exactness of coders, damage, code costs, checksums; and small block operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import config, quant, samples
from ..operators import containers, tiles, transforms
from ..operators.coders import CODERS, huffman
from ..session import table
from . import codecs
from .registry import SAMPLES, blocks, query, r6

_STEP, _ZONE = 6.0, 0.75
#: The frames of codecs.frames by label, with the quantised samples of their blocks.
_PLACES = "(SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n FROM embeddings)"
_INDICES = f"""(SELECT CAST(label AS BIGINT) AS seq_id, CAST(n // 16 AS BIGINT) AS frame_idx, CASE WHEN abs(v) < {_STEP * _ZONE} THEN 0 ELSE sign(v) * floor(abs(v) / {_STEP} + 0.5) END AS q
FROM (SELECT label, n, round(CAST(unnest(embedding) AS DOUBLE) * 100) AS v FROM {_PLACES}))"""


@query(f"SELECT seq_id, frame_idx, coder, true AS exact, true AS coded FROM (SELECT DISTINCT seq_id, frame_idx FROM {_INDICES}), (SELECT unnest([{', '.join(repr(c) for c in CODERS)}]) AS coder)")
def coders_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every tile comes back from its bytes under every coder: all do."""
    t = codecs._index_tiles(spark, sf_dir)
    parts = [tiles.round_trip(t, name, codecs._SIDE, 2).select("seq_id", "frame_idx", F.lit(name).alias("coder"), "exact", (F.col("bytes") > 0).alias("coded")) for name in CODERS]
    return reduce(DataFrame.unionByName, parts)


@query(f"SELECT seq_id, frame_idx, frame_idx % 5 <> 0 AS valid, frame_idx % 5 = 0 OR bool_and(q = 0) AS zero FROM {_INDICES} GROUP BY 1, 2")
def damage_substituted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth tile is damaged; the damaged ones and no others are found, and become zeros."""
    return codecs.damaged_tiles(spark, sf_dir)


@query(f"SELECT seq_id, count(DISTINCT frame_idx) AS frames, true AS contiguous FROM {_INDICES} GROUP BY 1")
def container_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the index of every label's file lists its frames in order, each where the one before it ends."""
    index = codecs.container_index(spark, sf_dir)
    w = Window.partitionBy("seq_id").orderBy("pts")
    ends = F.lag(F.col("offset") + F.col("size")).over(w)
    head = F.lit(containers.SEQUENCE_HEADER) + F.lit(containers.SEQUENCE_ENTRY) * F.count("*").over(Window.partitionBy("seq_id"))
    placed = index.withColumn("ok", F.col("offset") == F.coalesce(ends, head))
    return placed.groupBy("seq_id").agg(F.count("*").alias("frames"), F.bool_and("ok").alias("contiguous"))


_MAGNITUDES = "(SELECT event_type, CAST(least(floor(value / 32), 7) AS INTEGER) AS m, count(*) AS n FROM events GROUP BY 1, 2)"


@query(f"""WITH RECURSIVE h(event_type, symbols, ws, cost) AS (
SELECT event_type, count(*), list_sort(list(n)), 0::HUGEINT FROM {_MAGNITUDES} GROUP BY 1
UNION ALL SELECT event_type, symbols, list_sort(list_append(ws[3:], ws[1] + ws[2])), cost + ws[1] + ws[2] FROM h WHERE len(ws) > 1)
SELECT event_type, symbols, CAST(cost AS BIGINT) AS bits, 1.0::DOUBLE AS kraft FROM h WHERE len(ws) = 1""")
def huffman_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols, total length and Kraft sum of every event type's code over eight magnitudes, which no limit of length binds: the length is the least, the sum is whole."""
    m = F.least(F.floor(F.col("value") / 32), F.lit(7)).cast("int").alias("m")
    counts = table(spark, sf_dir, "events").groupBy("event_type", m).agg(F.count("*").alias("n")).groupBy("event_type").agg(F.map_from_entries(F.collect_list(F.struct("m", "n"))).alias("counts"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            freq = [[int(dict(c).get(s, 0)) for s in range(8)] for c in pdf["counts"]]
            bits = [huffman.code_lengths(f) for f in freq]
            rows = [(e, sum(x > 0 for x in f), sum(x * n for x, n in zip(f, b, strict=True)), sum(2.0**-n for n in b if n)) for e, f, b in zip(pdf["event_type"], freq, bits, strict=True)]
            yield pd.DataFrame(rows, columns=["event_type", "symbols", "bits", "kraft"])

    return counts.mapInPandas(run, "event_type string, symbols long, bits long, kraft double")


#: CRC-32 of a list of two-digit bytes by a table that follows from the polynomial.
_CRC_STEP = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"


def _crc_table() -> str:
    steps = "SELECT n, CAST(n AS BIGINT) AS c0 FROM range(256) r(n)"
    for k in range(8):
        steps = f"SELECT *, {_CRC_STEP.format(f'c{k}')} AS c{k + 1} FROM ({steps})"
    return f"(SELECT list(c8 ORDER BY n) AS crc FROM ({steps}))"


@query(f"""SELECT doc_id, len(b)::BIGINT AS size, xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, crc[CAST(xor(a, x) & 255 AS INTEGER) + 1])), 4294967295)::BIGINT AS crc
FROM (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(head)), '..'), lambda h: CAST(concat('0x', h) AS BIGINT)) AS b FROM (SELECT page_id AS doc_id, url AS head FROM pages)), {_crc_table()}""")
def crc32_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksum and size of every page's URL as a blob."""
    blob = F.col("url").cast("binary")
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.octet_length("url").cast("long").alias("size"), F.crc32(blob).alias("crc"))


@query(f"SELECT vec_id, CAST((y * 8 + x) % 3 AS BIGINT) AS part, CAST((y * 8 + x) // 3 AS BIGINT) AS at, round(v, 6) + 0.0 AS v FROM {SAMPLES}")
def deinterleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of three interleaved planes, taken apart."""
    parts = blocks(spark, sf_dir).select("vec_id", samples.deinterleave(F.col("a")).alias("p"))
    each = [parts.select("vec_id", F.lit(k).cast("long").alias("part"), F.posexplode(F.col(f"p.p{k}")).alias("at", "v")) for k in range(3)]
    return reduce(DataFrame.unionByName, each).select("vec_id", "part", F.col("at").cast("long").alias("at"), r6(F.col("v"), "v"))


@query(f"SELECT vec_id, CAST(x * 3 + least(y, 2) AS BIGINT) AS at, round(v, 6) + 0.0 AS v FROM {SAMPLES} WHERE y < 3")
def interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three rows of every block as planes, put together sample by sample."""
    rows = [F.slice("a", 8 * k + 1, F.lit(8)) for k in range(3)]
    b = blocks(spark, sf_dir).select("vec_id", F.posexplode(samples.interleave(*rows)).alias("at", "v"))
    return b.select("vec_id", F.col("at").cast("long").alias("at"), r6(F.col("v"), "v"))


_LAST = "(SELECT *, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS old FROM embeddings)"


@query(f"""SELECT vec_id, round(sad, 6) + 0.0 AS sad, sad < 900 AS zeroed, CASE WHEN sad < 900 THEN 0.0 ELSE round(list_sum(list_transform(embedding, lambda c: abs(CAST(c AS DOUBLE) * 100))), 6) END AS magnitude
FROM (SELECT vec_id, embedding, list_sum(list_transform(list_zip(embedding, old), lambda p: abs(CAST(p[1] AS DOUBLE) * 100 - CAST(p[2] AS DOUBLE) * 100))) AS sad FROM {_LAST} WHERE old IS NOT NULL)""")
def zero_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that differ from the label's block before by less than a sum of 900 become zeros."""
    b = blocks(spark, sf_dir).withColumn("old", F.lag("a").over(Window.partitionBy("label").orderBy("vec_id"))).where("old is not null")
    z = tiles.zero_by_sad(b.withColumnRenamed("a", "data"), F.col("old"), 900.0)
    magnitude = F.aggregate("data", F.lit(0.0), lambda s, x: s + F.abs(x))
    return z.select("vec_id", r6(F.col("sad"), "sad"), (F.col("sad") < 900).alias("zeroed"), r6(magnitude, "magnitude"))


@query(f"SELECT vec_id, round(max(abs(v)), 6) AS most, max(abs(v)) < 0.75 * 300 AS skipped FROM {SAMPLES} GROUP BY 1")
def all_zero_highpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks no sample of which leaves the dead zone of a step of 300: they need no code."""
    most = F.array_max(F.transform("a", F.abs))
    return blocks(spark, sf_dir).select("vec_id", F.round(most, 6).alias("most"), quant.all_zero(most, 300.0, 0.75).alias("skipped"))


@query("""SELECT l_orderkey, l_linenumber, tile, CAST(greatest(256, least(CASE WHEN tile <= 128 THEN 1024 ELSE 4096 END, pow(2, ceil(log2(greatest(1, floor(15.0 / (1 + 0.3 * least(greatest(step, 0.5), 64)) * tile * tile / 8 * 3 / 256))))))) AS BIGINT) AS bytes
FROM (SELECT l_orderkey, l_linenumber, l_quantity / 2.0 AS step, unnest([64, 128, 256, 512]) AS tile FROM lineitem)""")
def rice_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that a stream of a Rice tile may take, by tile size and step."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 2.0).alias("step"), F.explode(F.array(*map(F.lit, (64, 128, 256, 512)))).alias("tile"))
    return li.select("l_orderkey", "l_linenumber", "tile", config.rice_stream_bytes(F.col("tile"), F.col("step")).alias("bytes"))


#: The orthonormal cosine basis and the Walsh-Hadamard basis, from their definitions.
_COS = "(CASE k WHEN 0 THEN sqrt(0.125) ELSE 0.5 END * list_sum(list_transform(range(8), lambda i: s[i + 1] * cos((2 * i + 1) * k * pi() / 16))))"


def _two_ways(base: str, n: int, kernel: str) -> str:
    ks = f"(SELECT unnest(range({n})) AS k)"
    return f"""(SELECT vec_id, k0 AS x, CAST(k AS BIGINT) AS y, {kernel} AS c FROM (SELECT vec_id, k0, list(v ORDER BY y) AS s FROM
 (SELECT vec_id, y, CAST(k AS BIGINT) AS k0, {kernel} AS v FROM (SELECT vec_id, y, list(v ORDER BY x) AS s FROM {base} GROUP BY 1, 2), {ks}) GROUP BY 1, 2), {ks})"""


@query(f"SELECT vec_id, x, y, round(c, 5) + 0.0 AS c FROM {_two_ways(SAMPLES, 8, _COS)}")
def dct8_by_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cosine transform of every block, against a basis from the definition."""
    a = blocks(spark, sf_dir).select("vec_id", F.posexplode(transforms.dct(F.col("a"))).alias("p", "c"))
    return a.select("vec_id", (F.col("p") % 8).cast("long").alias("x"), F.floor(F.col("p") / 8).alias("y"), (F.round("c", 5) + F.lit(0.0)).alias("c"))


_Q8 = f"(SELECT vec_id, x, y, CASE WHEN abs(c) < {_STEP * _ZONE} THEN 0 ELSE sign(c) * floor(abs(c) / {_STEP} + 0.5) END AS v FROM {_two_ways(SAMPLES, 8, _COS)})"
_BACK = "list_sum(list_transform(range(8), lambda i: s[i + 1] * CASE i WHEN 0 THEN sqrt(0.125) ELSE 0.5 END * cos((2 * k + 1) * i * pi() / 16)))"


@query(f"SELECT vec_id, x, y, CAST(q.v AS BIGINT) AS q, round(r.c * {_STEP}, 4) + 0.0 AS r FROM {_Q8} q JOIN {_two_ways(_Q8, 8, _BACK)} r USING (vec_id, x, y)")
def dct8_quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices and reconstruction of every block from one projection."""
    a = blocks(spark, sf_dir).select("vec_id", transforms.dct_quantized(F.col("a"), _STEP, _ZONE).alias("d"))
    a = a.select("vec_id", F.posexplode(F.arrays_zip("d.indices", "d.back")).alias("p", "z"))
    return a.select(
        "vec_id", (F.col("p") % 8).cast("long").alias("x"), F.floor(F.col("p") / 8).alias("y"), F.col("z.indices").alias("q"), (F.round("z.back", 4) + F.lit(0.0)).alias("r")
    )
