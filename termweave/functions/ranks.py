"""Functions on rank vectors: normalise, invert, fit and compare, within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _with_totals(df: DataFrame, by: tuple[str, ...], **totals: Column) -> DataFrame:
    """Add totals of each group, which are summed in parts and sent to all tasks as one row a group."""
    rows = df.groupBy(*by).agg(*(c.alias(n) for n, c in totals.items()))
    return df.join(F.broadcast(rows), list(by)) if by else df.join(F.broadcast(rows))


def scale(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Values that sum to 1 in each group; uniform where the sum is 0."""
    met = _with_totals(df, by, _t=F.sum(column), _n=F.count(F.lit(1)))
    return met.withColumn(column, F.when(F.col("_t") == 0, 1.0 / F.col("_n")).otherwise(F.col(column) / F.col("_t"))).drop("_t", "_n")


def invert(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Twice the maximum less the value, to sum 1; uniform where all values are 0."""
    met = _with_totals(df, by, _m=F.max(column), _t=F.sum(column), _n=F.count(F.lit(1)))
    turned = (2.0 * F.col("_m") - F.col(column)) / (2.0 * F.col("_m") * F.col("_n") - F.col("_t"))
    return met.withColumn(column, F.when(F.col("_m") == 0, 1.0 / F.col("_n")).otherwise(turned)).drop("_m", "_t", "_n")


def fit(df: DataFrame, column: str, target: float, *by: str) -> DataFrame:
    """Values scaled so that each group's maximum is the target; all 0 stay 0."""
    met = _with_totals(df, by, _m=F.max(column))
    return met.withColumn(column, F.when(F.col("_m") == 0, F.col(column)).otherwise(F.col(column) * target / F.col("_m"))).drop("_m")


def delta(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sum of absolute differences of two vectors, as one row ``delta``."""
    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full_outer")
    return both.agg(F.coalesce(F.sum(F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))), F.lit(0.0)).alias("delta"))


#: Influence of a distance: by name, for amplified and dampened points.
INFLUENCES = {
    "none": lambda x: F.lit(0.0),
    "linear": lambda x: x.cast("double"),
    "cubic": lambda x: F.pow(x.cast("double"), F.lit(3.0)),
    "exponential": lambda x: F.pow(F.lit(2.0), x.cast("double")),
}
