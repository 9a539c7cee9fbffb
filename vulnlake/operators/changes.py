"""Files, methods and lines touched by commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.text import language, line_range, packed, unpacked

LINE_BIN = 100


def changed_methods(lines: DataFrame, methods: DataFrame, file: str, side: str | None = None) -> DataFrame:
    """Methods whose span holds at least one changed line, each once.

    ``lines`` has ``(file, [side,] line)``, ``methods`` ``(file, [side,] start_line, end_line, ..)``.  Lines and
    spans are cut into bins, so the join is on equal keys and a large file spreads over many bins.  The lines of a bin
    are one row with at most ``LINE_BIN`` of them.  Methods of one bin are made distinct where they are joined; only
    those that reach over several bins are shuffled again.
    """
    ids = [c for c, kind in methods.dtypes if kind == "string" and (c == file or c.endswith("_id"))]
    at = F.col("line")
    keys = {
        "_file": packed(F.col(file)) if file in ids else F.col(file),
        "_side": F.coalesce(F.concat(F.lit("="), F.col(side)), F.lit("")) if side else F.lit(""),
    }
    changed = (
        lines.select(*[k.alias(n) for n, k in keys.items()], F.floor(at / LINE_BIN).alias("_bin"), at.alias("_line"))
        .groupBy("_file", "_side", "_bin").agg(F.collect_set("_line").alias("_lines"))
    )
    low, high = F.floor(F.col("start_line") / LINE_BIN), F.floor(F.col("end_line") / LINE_BIN)
    spans = methods.withColumns({"_file": keys["_file"], "_side": keys["_side"], **{c: packed(F.col(c)) for c in ids if c != file}})
    spans = spans.drop(file).withColumn("_bin", F.explode(F.sequence(low, high)))
    hit = F.exists("_lines", lambda line: line.between(F.col("start_line"), F.col("end_line")))

    def found(rows: DataFrame) -> DataFrame:
        return rows.join(changed, ["_file", "_side", "_bin"]).filter(hit).drop("_lines")

    once = found(spans.filter(low == high)).distinct()
    several = found(spans.filter(low < high)).drop("_bin").distinct()
    both = once.drop("_bin").unionByName(several)
    back = {c: unpacked(F.col(c)) for c in ids if c != file} | {file: unpacked(F.col("_file")) if file in ids else F.col("_file")}
    return both.withColumns(back).select(*methods.columns)


def file_rows(commits: DataFrame) -> DataFrame:
    """One row per modified file with a stable id; files without text changes go.

    ``commits`` has ``hash`` and ``modified_files``, an array of file structs.
    """
    files = commits.select("hash", F.explode("modified_files").alias("f")).select("hash", "f.*")
    textual = (F.col("num_lines_added") != 0) | (F.col("num_lines_deleted") != 0)
    return (
        files.filter(F.coalesce(textual, F.lit(True)))
        .withColumn("file_change_id", F.xxhash64("hash", "old_path", "new_path").cast("string"))
        .withColumn("programming_language", language(F.coalesce("new_path", "old_path"), F.col("code_after")))
    )


def method_rows(files: DataFrame, spans: DataFrame, lines: DataFrame) -> DataFrame:
    """Changed methods before and after with their code.

    ``spans`` and ``lines`` carry ``side`` (``deleted`` counts against the code before, ``added`` after).
    """
    hit = changed_methods(lines, spans, "file_change_id", "side")
    named = hit.filter(F.col("name") != "(anonymous)")
    before = F.col("side") == "deleted"
    source = F.when(before, F.col("code_before")).otherwise(F.col("code_after"))
    return (
        named.join(files.select("file_change_id", "code_before", "code_after"), "file_change_id")
        .withColumn("_source", source)
        .filter(F.col("_source").isNotNull())
        .withColumn("code", line_range(F.col("_source"), F.col("start_line"), F.col("end_line")))
        .withColumn("before_change", before)
        .withColumn(
            "method_change_id",
            F.xxhash64("file_change_id", "side", "signature", "start_line", "end_line").cast("string"),
        )
        .drop("_source", "code_before", "code_after", "side")
    )
