"""Session helpers shared by queries, tests and the bench."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tesserae", cpus: str | int = "*", partitions: int | None = None) -> SparkSession:
    """A single-machine session for tests and benchmarks; a cluster brings its own."""
    n = partitions or (os.cpu_count() if cpus == "*" else int(cpus))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
