"""Recorded statistics: long rows ``(path.., value, unit)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.operators.keyed import running_total


def collected(rows: DataFrame, path: Sequence[str], value: str) -> DataFrame:
    """Values of a path with how often each occurs: the list is the rows with ``n``, the set the rows.

    A path's values stay rows, so no path has to fit into one array.
    """
    return rows.groupBy(*path, value).agg(F.count("*").alias("n"))


def unit_conflicts(rows: DataFrame, path: Sequence[str], unit: str) -> DataFrame:
    return rows.groupBy(*path).agg(F.countDistinct(unit).alias("units")).filter(F.col("units") > 1)


def exact_median(rows: DataFrame, path: Sequence[str], value: str) -> DataFrame:
    """Median per path ``(path.., median)`` over a running count of the sorted distinct values.

    Equal values are counted before the sort; the sort is by (path, value) over the whole table, so one path
    with most of the rows still spreads over all slices.
    """
    counts = collected(rows.filter(F.col(value).isNotNull()), path, value)
    summed = running_total(counts, [*[F.col(p) for p in path], F.col(value)], F.col("n"), "_upto")
    groups = summed.groupBy(*path).agg(F.max("_upto").alias("_end"), F.sum("n").alias("_n"))
    placed = summed.join(groups, list(path)).withColumn("_start", F.col("_end") - F.col("_n"))
    high = F.col("_upto") - F.col("_start")
    low = high - F.col("n") + 1
    lower, upper = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    return placed.groupBy(*path).agg(
        (
            (F.min(F.when(lower.between(low, high), F.col(value))) + F.min(F.when(upper.between(low, high), F.col(value))))
            / 2
        ).alias("median")
    )


def summary(rows: DataFrame, path: Sequence[str], value: str) -> DataFrame:
    """Mean, sample deviation, median, count and sum of every path with more than one value."""
    plain = rows.groupBy(*path).agg(
        F.avg(value).alias("average"), F.stddev_samp(value).alias("deviation"),
        F.count(value).alias("count"), F.sum(value).alias("sum"),
    ).filter(F.col("count") > 1)
    return plain.join(exact_median(rows, path, value), list(path))


def tree(rows: DataFrame, path: Sequence[str], value: str) -> DataFrame:
    """Every level of the hierarchy with its dotted path, number of values and sum."""
    rolled = rows.rollup(*path).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.grouping_id().alias("_g"))
    names = F.concat_ws(".", *[F.col(p).cast("string") for p in path])
    return rolled.filter(F.col("_g") < (1 << len(path)) - 1).select(names.alias("path"), "n", "total")
