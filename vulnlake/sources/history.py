"""Exported repository history: commit logs, patches, reports and small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vulnlake import constants as K
from vulnlake import schema as S


def read_git_log(spark: SparkSession, path: str) -> DataFrame:
    """Commits of exported logs ``(file, commit_id, timestamp, parent_id, message, changed_files)``.

    The separator line is the record delimiter, so a long log is split over tasks at commit parts.  A part is a
    header, a message or a file list; a header looks like nothing else, and its two successors follow by position.
    """
    parts = (
        spark.read.option("lineSep", K.LOG_SEPARATOR).text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
                F.monotonically_increasing_id().alias("_id"), "value")
    )
    return parse_log_parts(parts)


def parse_log_parts(parts: DataFrame) -> DataFrame:
    """Parts ``(file, _block, _id, value)`` to commits, one window per file split.

    A header near the end of a split is carried on: it takes its message and file list from the next parts, in
    whatever splits they begin.  Splits in which no part begins have no row, so the two parts after a split lie in the
    next one that has any, or, where that has a single part, in it and the one after.  Those few parts are copied back;
    what is ordered over a file is one narrow row for each split, never its parts.
    """
    header = r"^\s*([0-9a-f]{6,40}):(\d+):([0-9a-f ]*)\s*$"
    order = Window.partitionBy("file").orderBy("_block")
    splits = parts.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_size"))
    before = splits.select(
        "file", "_block", F.lag("_block").over(order).alias("_before1"), F.lag("_block", 2).over(order).alias("_before2"),
        F.lag("_size").over(order).alias("_size1"),
    )
    inside = Window.partitionBy("file", "_block").orderBy("_id")
    numbered = parts.withColumn("_n", F.row_number().over(inside))
    to = F.array(
        F.struct(F.col("_before1").alias("_to"), F.lit(1).alias("_copy")),
        F.struct(F.when((F.col("_size1") == 1) & (F.col("_n") == 1), F.col("_before2")).alias("_to"), F.lit(2).alias("_copy")),
    )
    copied = (
        numbered.filter("_n <= 2").join(before, ["file", "_block"])
        .select("file", F.explode(to).alias("_c"), "_id", "value").filter("_c._to IS NOT NULL")
        .select("file", F.col("_c._to").alias("_block"), "_id", "value", F.col("_c._copy").alias("_copy"))
    )
    w = Window.partitionBy("file", "_block").orderBy("_copy", "_id")
    lines = F.filter(F.split("_files", "\n"), lambda x: F.trim(x) != "")
    text = F.filter(F.split("_message", "\n"), lambda x: F.trim(x) != "")
    return (
        numbered.drop("_n").withColumn("_copy", F.lit(0)).unionByName(copied)
        .withColumn("_message", F.lead("value", 1).over(w))
        .withColumn("_files", F.lead("value", 2).over(w))
        .filter((F.col("_copy") == 0) & F.col("value").rlike(header))
        .select(
            "file", F.regexp_extract("value", header, 1).alias("commit_id"),
            F.regexp_extract("value", header, 2).cast("long").alias("timestamp"),
            F.split(F.trim(F.regexp_extract("value", header, 3)), " ")[0].alias("parent_id"),
            F.trim(F.array_join(text, " ")).alias("message"),
            F.coalesce(lines, F.array().cast("array<string>")).alias("changed_files"),
        )
    )


def read_patches(spark: SparkSession, path: str, cap: int | None = None) -> DataFrame:
    """Patch texts ``(file, patch)``; with ``cap``, files of more bytes are left out before any is read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if cap is not None:
        rows = rows.filter(F.col("length") <= cap)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("content").cast("string").alias("patch"))


def stored_patches(spark: SparkSession, path: str) -> DataFrame:
    """Names of the patch files that are there."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("patch"))


def read_reports(spark: SparkSession, path: str, top: int | None = None) -> DataFrame:
    """Commits of ranking reports, the first ``top`` if given, with their scores ``(file, commit_id, score)`` above 0."""
    rows = spark.read.schema(S.REPORT).option("multiLine", True).json(path)
    first = rows.select(F.col("_metadata.file_path").alias("file"), F.explode("commits" if top is None else F.slice("commits", 1, top)).alias("c"))
    score = F.aggregate("c.matched_rules.relevance", F.lit(0), lambda a, x: a + x)
    return first.select("file", F.col("c.commit_id").alias("commit_id"), score.alias("score")).filter("score > 0")


def read_project_map(spark: SparkSession, path: str) -> DataFrame:
    """Projects, services and repositories of a comma-separated file with a header."""
    return spark.read.schema("project string, service_name string, repository string").option("header", True).csv(path)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a semicolon-separated file whose first field is a CVE id."""
    columns = "cve_id string, repository string, version string, tag string, commits string"
    return spark.read.schema(columns).option("sep", ";").csv(path).filter(F.col("cve_id").rlike(r"^CVE-\d{4}-\d{4,8}"))


def read_project_keywords(spark: SparkSession, path: str) -> DataFrame:
    """Search keywords of the projects ``(project, git, keyword)``."""
    rows = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "map<string, struct<git:string, `search keywords`:array<string>>>")
    projects = rows.select(F.explode(parsed).alias("project", "p"))
    return projects.select("project", "p.git", F.explode("p.`search keywords`").alias("keyword"))
