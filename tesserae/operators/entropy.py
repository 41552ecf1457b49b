"""Statistics that entropy coders need, and cost diagnostics, as aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import binary_entropy, median3, rice_k


def rice_parameters(df: DataFrame, keys: list[str], q: str = "q") -> DataFrame:
    """(keys, nonzero, k): Rice parameter of the magnitudes less one of each group's nonzero indices."""
    m = F.when(F.col(q) != 0, F.abs(q) - 1)
    g = df.groupBy(*keys).agg(F.coalesce(F.sum(m), F.lit(0)).alias("total"), F.count(m).alias("nonzero"))
    return g.select(*keys, "nonzero", rice_k(F.col("total"), F.col("nonzero")).alias("k"))


def skip_bitmap(df: DataFrame, keys: list[str], group: str = "grp", q: str = "q") -> DataFrame:
    """(keys, bitmap): a bit for each group whose indices are all zero."""
    g = df.groupBy(*keys, group).agg(F.bool_and(F.col(q) == 0).alias("zero"))
    return g.groupBy(*keys).agg(F.sum(F.when(F.col("zero"), F.expr(f"shiftleft(1, cast({group} as int))")).otherwise(0)).cast("long").alias("bitmap"))


def histogram(df: DataFrame, keys: list[str], symbol: Column) -> DataFrame:
    return df.groupBy(*keys, symbol.alias("symbol")).agg(F.count("*").alias("n"))


def normalize_largest(hist: DataFrame, keys: list[str], total: int = 4096) -> DataFrame:
    """Adds freq: counts scaled to sum to total, at least one each; the largest (first on ties) takes up the difference."""
    w = Window.partitionBy(*keys)
    scaled = F.greatest(F.floor(F.col("n") * total / F.sum("n").over(w)), F.lit(1)).cast("long")
    h = hist.withColumn("_f", scaled).withColumn("_r", F.row_number().over(w.orderBy(F.desc("n"), "symbol")))
    return h.withColumn("freq", F.col("_f") + F.when(F.col("_r") == 1, total - F.sum("_f").over(w)).otherwise(0)).drop("_f", "_r")


def normalize_spread(hist: DataFrame, keys: list[str], total: int = 4096) -> DataFrame:
    """The same by descending counts: a deficit is handed out in shares of total over the number of symbols, what is left to the first; a surplus is taken
    from each down to one."""
    w = Window.partitionBy(*keys)
    by = w.orderBy(F.desc("n"), "symbol")
    scaled = F.greatest(F.floor(F.col("n") * total / F.sum("n").over(w)), F.lit(1)).cast("long")
    h = hist.withColumn("_f", scaled).withColumns({"_gap": total - F.sum("_f").over(w), "_share": F.greatest(F.floor(F.lit(total) / F.count("*").over(w)), F.lit(1)), "_r": F.row_number().over(by)})
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    given = F.least(F.col("_share"), F.greatest(F.col("_gap") - F.col("_share") * (F.col("_r") - 1), F.lit(0)))
    rest = F.col("_gap") - F.least(F.col("_gap"), F.col("_share") * F.count("*").over(w))
    room = F.col("_f") - 1
    taken = F.least(room, F.greatest(-F.col("_gap") - F.coalesce(F.sum(room).over(before), F.lit(0)), F.lit(0)))
    freq = F.when(F.col("_gap") > 0, F.col("_f") + given + F.when(F.col("_r") == 1, rest).otherwise(0)).when(F.col("_gap") < 0, F.col("_f") - taken).otherwise(F.col("_f"))
    return h.withColumn("freq", freq.cast("long")).drop("_f", "_gap", "_share", "_r")


def cumulative(df: DataFrame, keys: list[str], freq: str = "freq") -> DataFrame:
    """Adds cum: the sum of the frequencies of smaller symbols."""
    w = Window.partitionBy(*keys).orderBy("symbol").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("cum", F.coalesce(F.sum(freq).over(w), F.lit(0)).cast("long"))


def symbol_lookup(slots: DataFrame, table: DataFrame, keys: list[str], slot: str = "slot") -> DataFrame:
    """Joins each slot with the symbol whose range [cum, cum + freq) holds it: as-of by a window over both, no range join."""
    marks = table.select(*keys, F.col("cum").alias("_at"), F.struct("symbol", "freq", "cum").alias("_s"), F.lit(None).cast("long").alias("_slot"))
    asked = slots.select(*keys, F.col(slot).alias("_at"), F.lit(None).cast(marks.schema["_s"].dataType).alias("_s"), F.col(slot).cast("long").alias("_slot"))
    w = Window.partitionBy(*keys).orderBy("_at", F.col("_slot").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(asked).withColumn("_s", F.last("_s", True).over(w))
    return both.where("_slot is not null").select(*keys, F.col("_slot").alias(slot), "_s.symbol", "_s.freq", "_s.cum")


def significance(df: DataFrame, keys: list[str], q: str = "q") -> DataFrame:
    """(keys, n, flat, given_above): entropy of being nonzero, alone and given the sample above in the same column."""
    above = F.lag(q).over(Window.partitionBy("vec_id", *keys, "x").orderBy("y"))
    s = df.withColumns({"sig": (F.col(q) != 0).cast("long"), "ctx": F.coalesce((above != 0).cast("long"), F.lit(0))})
    n, c = F.count("*"), lambda v, x: F.count_if((F.col("ctx") == x) & v)
    g = s.groupBy(*keys).agg(n.alias("n"), F.sum("sig").alias("s"), *(c(F.lit(True), x).alias(f"n{x}") for x in (0, 1)), *(c(F.col("sig") == 1, x).alias(f"s{x}") for x in (0, 1)))
    part = lambda x: F.when(F.col(f"n{x}") > 0, F.col(f"n{x}") / F.col("n") * binary_entropy(F.col(f"s{x}") / F.col(f"n{x}"))).otherwise(0.0)
    return g.select(*keys, "n", binary_entropy(F.col("s") / F.col("n")).alias("flat"), (part(0) + part(1)).alias("given_above"))


def pair_correlation(df: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """(keys, n, r): correlation of magnitudes of neighbours in disjoint pairs along rows; null under two pairs or without variation."""
    pair = df.groupBy(*keys, "vec_id", "y", F.floor(F.col("x") / 2).alias("p")).agg(
        F.max(F.when(F.col("x") % 2 == 0, F.abs(value))).alias("a"), F.max(F.when(F.col("x") % 2 == 1, F.abs(value))).alias("b")
    )
    g = pair.where("a is not null and b is not null").groupBy(*keys).agg(F.count("*").alias("n"), F.corr("a", "b").alias("r"), F.var_pop("a").alias("va"), F.var_pop("b").alias("vb"))
    return g.select(*keys, "n", F.when((F.col("n") >= 2) & (F.col("va") > 1e-12) & (F.col("vb") > 1e-12), F.col("r")).alias("r"))


def vector_predictors(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds px, py: median of the left, upper and upper right vector; missing ones are zero, a missing upper right is the upper."""
    row = Window.partitionBy(*keys, "y").orderBy("x")
    col = Window.partitionBy(*keys, "x").orderBy("y")
    left = F.lag(F.struct("dx", "dy")).over(row)
    df = df.withColumns({"_l": left, "_a": F.lag(F.struct("dx", "dy")).over(col)})
    df = df.withColumn("_r", F.when(F.col("_a").isNotNull(), F.coalesce(F.lead("_a").over(row), F.col("_a"))))
    zero = lambda c, n: F.coalesce(F.col(f"{c}.{n}"), F.lit(0))
    return df.withColumns({f"p{a}": median3(*(zero(c, f"d{a}") for c in ("_l", "_a", "_r"))) for a in ("x", "y")}).drop("_l", "_a", "_r")


def vector_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Count, zeros, mean, median (the upper), maximum of the larger component, and counts of it in six ranges."""
    m = F.greatest(F.abs("dx"), F.abs("dy"))
    edges = ((0, 0), (1, 2), (3, 4), (5, 8), (9, 16), (17, None))
    counts = [F.count_if((m >= a) & (m <= b) if b is not None else m >= a).alias(f"h{i}") for i, (a, b) in enumerate(edges)]
    # the median of a group of any size comes from its histogram of magnitudes
    hist = df.groupBy(*keys, m.alias("m")).agg(F.count("*").alias("c"))
    run = F.sum("c").over(Window.partitionBy(*keys).orderBy("m"))
    total = F.sum("c").over(Window.partitionBy(*keys))
    middle = hist.withColumns({"_run": run, "_half": F.floor(total / 2)}).where(F.col("_run") > F.col("_half")).groupBy(*keys).agg(F.min("m").alias("median"))
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if((F.col("dx") == 0) & (F.col("dy") == 0)).alias("zeros"), F.avg(m).alias("mean"), F.max(m).alias("most"), *counts)
    return g.join(middle, keys)


def picks(df: DataFrame, keys: list[str], value: str, percents: tuple[int, ...] = (10, 50, 90)) -> DataFrame:
    """(keys, p10, ...): the sorted value at place p * n div 100; from ranks, so that no group is gathered."""
    w = Window.partitionBy(*keys)
    r = df.withColumns({"_i": F.row_number().over(w.orderBy(value)) - 1, "_n": F.count("*").over(w)})
    return r.groupBy(*keys).agg(*(F.max(F.when(F.col("_i") == F.least(F.floor(F.col("_n") * p / 100), F.col("_n") - 1), F.col(value))).alias(f"p{p}") for p in percents))


def warnings(ratio: Column, zero_rate: Column, skips: Column, mean_abs: Column, near_zero: Column, coefficient_ratio: Column, mean_k: Column) -> Column:
    """Names of the findings of a predicted frame's diagnostics."""
    checks = (
        ("size_ratio", ratio > 0.7), ("no_zero_vectors", zero_rate == 0), ("no_skips", skips == 0), ("residual", mean_abs > 15), ("near_zero", near_zero < 50),
        ("coefficients", coefficient_ratio > 0.9), ("magnitudes", mean_k > 5),
    )
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in checks)))
