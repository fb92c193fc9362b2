"""Privacy-preserving aggregates and calibration metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL_CELL = 5


def suppressed(n: Column, least: int = SMALL_CELL) -> Column:
    """A count, or null for 1 to least - 1."""
    return F.when((n >= least) | (n == 0), n)


def bin_of(value: Column, edges: list[float]) -> Column:
    """Number of the bin [low, high), the last one closed; null outside. A chain of comparisons, inside code generation."""
    out = F.when(value == edges[-1], len(edges) - 2)
    for i, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        out = out.when((value >= low) & (value < high), i)
    return out


def histogram(df: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """(bin, label, n) with all bins, small cells null. Each task sends one row of counts."""
    at = bin_of(value, edges)
    counts = df.agg(*(F.count_if(at == i).alias(f"n{i}") for i in range(len(edges) - 1)))
    rows = F.array(*(F.struct(F.lit(i).cast("long").alias("bin"), F.lit(f"{a:g}–{b:g}").alias("label"), F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))))
    return counts.select(F.inline(rows)).select("bin", "label", suppressed(F.col("n")).alias("n"))


def rates(df: DataFrame, keys: list[str], positive: Column) -> DataFrame:
    """tested, positive, rate, suppressed and missing for each group; positive is null where not tested."""
    g = df.groupBy(*keys).agg(F.count(positive).alias("tested"), F.count_if(positive).alias("pos"), (F.count("*") - F.count(positive)).alias("missing"))
    hidden = (F.col("pos") > 0) & (F.col("pos") < SMALL_CELL)
    rate = F.when(~hidden & (F.col("tested") > 0), F.round(F.col("pos") / F.col("tested"), 4))
    return g.select(*keys, "tested", suppressed(F.col("pos")).alias("positive"), rate.alias("rate"), hidden.alias("suppressed"), "missing")


def any_true(c: Column) -> Column:
    """True if one is, false if one is false and none true, null if all are null."""
    return F.bool_or(c)


def reliability(df: DataFrame, confidence: Column, right: Column, bins: int = 10) -> DataFrame:
    """(bin, n, acc) of confidence tenths."""
    at = F.least(F.lit(bins - 1), F.floor(confidence * bins)).cast("long")
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(right, 1.0).otherwise(0.0)), 4).alias("acc"))


def calibration_error(df: DataFrame, confidence: Column, right: Column, bins: int = 10) -> DataFrame:
    at = F.least(F.lit(bins - 1), F.floor(confidence * bins)).cast("long")
    by = df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.when(right, 1.0).otherwise(0.0)).alias("acc"))
    return by.agg(F.round(F.sum(F.abs(F.col("acc") - (F.col("bin") + 0.5) / bins) * F.col("n")) / F.sum("n"), 6).alias("ece"))


# The share and the number of blue regions that make a page's pen blue.
BLUE_SHARE, BLUE_LEAST = 0.15, 3


def pen(blue: Column) -> Column:
    """The pen of a page whose regions hold blue ink or not."""
    return F.when(F.count_if(blue) >= F.greatest(F.lit(BLUE_LEAST), F.count("*") * BLUE_SHARE), "blue").otherwise("dark")


def nested_size(items: Column) -> Column:
    """Sum of the sizes of lists, one for a row that has none."""
    return F.sum(F.when(items.isNull(), 1).otherwise(F.size(items)))


# Fixed value: what a number must fit for its sums to be exact.
PLACES = "decimal(18,6)"


def exact(value: Column) -> tuple[Column, Column]:
    """(its sum as a decimal, whether that is exact) of a group's doubles: so it is if all are decimals of six places at most."""
    d = value.try_cast(PLACES)
    return F.sum(d), F.count_if(value.isNotNull() & ~d.cast("double").eqNullSafe(value)) == 0


def rounded_sum(value: Column, digits: int) -> Column:
    """The sum, rounded half away from zero. A sum of doubles hangs on the order of its rows, which isn't fixed here."""
    total, whole = exact(value)
    return F.when(whole, F.round(total, digits).cast("double")).otherwise(F.round(F.sum(value), digits))


def rounded_mean(value: Column, digits: int) -> Column:
    """The mean, rounded half away from zero, in whole numbers throughout, so that a tie is told as one."""
    (total, whole), n = exact(value), F.nullif(F.count(value), F.lit(0))
    units = F.call_function("div", F.abs(total) * (2 * 10**digits) + n, n * 2)
    return F.when(whole, F.signum(total.cast("double")) * units / 10**digits).otherwise(F.round(F.avg(value), digits))
