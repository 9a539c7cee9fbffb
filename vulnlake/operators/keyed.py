"""First, top-k and position operators that stay distributed when one key is hot."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vulnlake.session import cut_lineage


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key by ``order``, NULL last, ties broken by the other columns.

    A ``min`` over a struct combines on the map side, so a hot key sends one row per task through the
    shuffle instead of all its rows into one window.  NULL keys form a group of their own.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = [x for i, o in enumerate(order) for x in (o.isNull().alias(f"_n{i}"), o.alias(f"_o{i}"))]
    columns = [F.col(f"`{c}`") for c in rest]
    unordered = [f.name for f in df.schema if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString()]
    if unordered:  # maps cannot be compared, so they only go along
        compared = [F.col(f"`{c}`") for c in rest if c not in unordered]
        best = F.min_by(F.struct(*columns), F.struct(*ranked, *compared, F.lit(0))).alias("_best")
    else:
        best = F.min(F.struct(*ranked, *columns)).alias("_best")
    return (
        df.groupBy(*[F.col(f"`{k}`") for k in keys])
        .agg(best)
        .select(*[F.col(f"`{c}`") if c in keys else F.col(f"_best.`{c}`").alias(c) for c in df.columns])
    )


def top_k_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank", salts: int = 32
) -> DataFrame:
    """The first ``k`` rows of every key with their rank, starting at 1.

    Ranks twice: within ``salts`` slices of a key, dealt by the rows' places, then within the at most ``salts * k``
    rows left.  No column but the key and the order is looked at.
    """
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts))
    sliced = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn(rank, F.row_number().over(sliced))
        .filter(F.col(rank) <= k)
        .withColumn(rank, F.row_number().over(whole))
        .filter(F.col(rank) <= k)
        .drop("_salt")
    )


def _sorted_slices(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The sorted rows, kept: ``_slice`` is the sorted part of a row, ``_nth`` its place in it, from 0."""
    row = F.col("_row")
    kept = cut_lineage(df.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()))
    return kept.withColumns({"_slice": F.shiftright(row, 33), "_nth": row.bitwiseAND((1 << 33) - 1)}).drop("_row")


def _offsets(totals: DataFrame) -> dict[int, int]:
    """What stands before each slice, from one total per slice; as many numbers as the sort had parts."""
    before, out = 0, {}
    for row in sorted(totals.collect()):
        out[row[0]] = before
        before += row[1]
    return out


def running_total(df: DataFrame, order: Sequence[Column], weight: Column, name: str) -> DataFrame:
    """Sum of ``weight`` over all rows up to and including this one, over the whole table.

    Range-sorts the table, keeps the sorted copy, and reads it as it lies: every sorted slice is summed up as a stream,
    from the total of the slices before it.  Only one number per slice is ever brought together, and nothing but the
    sort is shuffled.
    """
    slices = _sorted_slices(df.withColumn("_weight", weight.cast("long")), order)
    offsets = _offsets(slices.groupBy("_slice").agg(F.sum("_weight")))

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = offsets[batch.column(0)[0].as_py()] if at is None else at
            total = np.cumsum(batch.column(1).to_numpy(zero_copy_only=False)) + at
            at = int(total[-1])
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(total, pa.int64())], ["_all", name])

    rows = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_all")
    schema = T.StructType([T.StructField("_all", df.schema), T.StructField(name, T.LongType())])
    return slices.select("_slice", "_weight", rows).mapInArrow(summed, schema).select("_all.*", name)


def with_position(df: DataFrame, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """Row number over the whole table, starting at 1: the place in its sorted slice after the rows of those before."""
    slices = _sorted_slices(df, order)
    offsets = _offsets(slices.groupBy("_slice").agg(F.count(F.lit(1))))
    spark = df.sparkSession
    before = spark.createDataFrame(list(offsets.items()), "_slice long, _before long")
    placed = slices.join(F.broadcast(before), "_slice")  # one row for each part of the sort
    return placed.withColumn(name, F.col("_before") + F.col("_nth") + 1).select(*[F.col(f"`{c}`") for c in df.columns], name)
