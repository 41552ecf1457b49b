"""Registration of queries with their DuckDB SQL, and the base frames they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that gives the same rows if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, pos, value): each user's events as an ordered signal from 0."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", (F.row_number().over(w) - 1).cast("long").alias("pos"), "value", "event_type", "event_id")


SERIES = "(SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value, event_type, event_id FROM events)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, x, y, v): each embedding as an 8x8 block of samples, 100 times its components."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "c"))
    return e.select("vec_id", "label", (F.col("i") % 8).cast("long").alias("x"), F.floor(F.col("i") / 8).alias("y"), (F.col("c").cast("double") * 100).alias("v"))


SAMPLES = (
    "(SELECT vec_id, label, CAST(i % 8 AS BIGINT) AS x, CAST(i // 8 AS BIGINT) AS y, CAST(c AS DOUBLE) * 100 AS v"
    " FROM (SELECT vec_id, label, unnest(embedding) AS c, unnest(range(len(embedding))) AS i FROM embeddings))"
)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, a): the same blocks as arrays of 64."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda c: c.cast("double") * 100).alias("a"))


def r6(c, name: str):
    """Rounded to six places, as sums differ in order between engines; negative zero becomes zero."""
    return (F.round(c, 6) + F.lit(0.0)).alias(name)
