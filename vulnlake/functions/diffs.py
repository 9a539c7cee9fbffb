"""Diff expressions and operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hunk_count(lines: Column) -> Column:
    """Runs of added or removed lines; file header lines neither start nor end a run."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(False).alias("open"))

    def step(state: Column, line: Column) -> Column:
        head = F.substring(line, 1, 3)
        change = F.substring(line, 1, 1).isin("+", "-")
        starts = change & ~state["open"]
        return F.when(head.isin("+++", "---"), state).otherwise(
            F.struct((state["n"] + starts.cast("int")).alias("n"), change.alias("open"))
        )

    return F.aggregate(F.filter(lines, lambda x: F.trim(x) != ""), zero, step, lambda state: state["n"])


def diff_lines(df: DataFrame, key: str, diff: str) -> DataFrame:
    """Added and deleted lines with their number: ``(key, side, line, text)``.

    Every diff line is one row; the numbers restart at each hunk header and run on with the lines of a side.
    """
    header = r"^@@ -(\d+)(?:,\d+)? \+(\d+)"
    rows = df.select(key, F.posexplode(F.split(diff, "\n")).alias("_pos", "_line"))
    first = F.substring("_line", 1, 1)
    is_head = F.col("_line").startswith("@@")
    is_file = F.col("_line").startswith("+++") | F.col("_line").startswith("---")
    rows = (
        rows.withColumn("_old", F.when(is_head, F.regexp_extract("_line", header, 1).try_cast("int")))
        .withColumn("_new", F.when(is_head, F.regexp_extract("_line", header, 2).try_cast("int")))
        .withColumn(
            "_side",
            F.when(is_head | is_file | (first == "\\"), "none")
            .when(first == "+", "added")
            .when(first == "-", "deleted")
            .otherwise("both"),
        )
    )
    upto = Window.partitionBy(key).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_hunk", F.sum(is_head.cast("int")).over(upto))
    inside = Window.partitionBy(key, "_hunk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)

    def number(start: str, side: str) -> Column:
        steps = F.sum(F.col("_side").isin(side, "both").cast("int")).over(inside)
        return F.first(start, ignorenulls=True).over(inside) + steps - 1

    return (
        rows.withColumn("_added", number("_new", "added"))
        .withColumn("_deleted", number("_old", "deleted"))
        .filter((F.col("_hunk") > 0) & F.col("_side").isin("added", "deleted"))
        .select(
            key,
            F.col("_side").alias("side"),
            F.when(F.col("_side") == "added", F.col("_added")).otherwise(F.col("_deleted")).alias("line"),
            F.expr("substring(_line, 2)").alias("text"),
        )
    )
