"""What the operators share: tables, the cluster's shared folder, written intermediate tables, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: Rows of one Arrow batch handed to Python: whole texts, so few of them.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, lengthened until df has no column of the name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def with_columns_from(df: DataFrame, run: Callable[[Iterator], Iterator], added: dict[str, DataType]) -> DataFrame:
    """df by a mapInArrow function that gets all columns and returns them by place, and added ones after them. Any column names will do."""
    own = [StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema.fields)]
    more = [StructField(f"c{len(own) + i}", t) for i, t in enumerate(added.values())]
    small_batches(df.sparkSession)
    return df.toDF(*(f.name for f in own)).mapInArrow(run, StructType([*own, *more])).toDF(*df.columns, *added)


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows of Arrow batches, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: What a Python worker keeps from one task to the next: the tables of one operator, never of two.
_kept: dict[Any, Any] = {}


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """The worker's object of this key, made if need be; others are let go."""
    if key not in _kept:
        let_go()
        _kept[key] = make()
    return _kept[key]


def let_go(keep: Any = None) -> None:
    """Drops what the worker keeps under other keys and gives freed memory back to the system."""
    for key in [k for k in _kept if k != keep]:
        del _kept[key]
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator], key: Any = None) -> Callable[[Iterator], Iterator]:
    """A mapInArrow function that, before and after its partition, drops what other operators left in the worker."""

    def tidied(batches: Iterator) -> Iterator:
        let_go(key)
        yield from run(batches)
        let_go(key)

    return tidied


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI below the shared folder that spark.checkpoint.dir names.

    Only where the setting is absent and all tasks run on this machine, as in tests, a temporary folder takes its place."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tesserae-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder, so that it outlives executors, and reads it back."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a table made by written()."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node of an undirected graph.

    links: columns u, v (bigint). Returns (node, root), one row per node that occurs in links; root is the
    smallest node of its component. Alternates large-star and small-star steps, which keep the number of edges
    bounded by the input's and need a logarithmic number of rounds. Every step is a partial-aggregated minimum and
    an equi-join that adaptive execution can split; no neighbour list is ever gathered. Null ends and loops are
    ignored.
    """
    edges = written(
        links.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    mark = _fingerprint(edges)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        after = written(_small_star(_large_star(edges)), "edges")
        new = _fingerprint(after)
        drop_written(edges)
        edges = after
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the smallest node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked with the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
    near = edges.join(least, F.col("u") == F.col("c")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()
