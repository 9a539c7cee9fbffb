"""Exports of finished tables, and repository metadata as stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str) -> None:
    """Zipped JSON lines, one file per task."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def write_first_rows(df: DataFrame, path: str, n: int = 10) -> None:
    """The first rows of an ordered result as one CSV file with a header."""
    df.limit(n).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def year_of(cve_id: Column) -> Column:
    """Year that a CVE id names, NULL where it names none."""
    return F.split_part(cve_id, F.lit("-"), F.lit(2)).try_cast("int")


def write_by_year(cve: DataFrame, path: str) -> None:
    """Records in one folder per year of the CVE id, so a reader of one year opens one folder."""
    cve.withColumn("year", year_of(F.col("cve_id"))).write.mode("overwrite").partitionBy("year").json(path)


def repository_rows(stored: DataFrame) -> DataFrame:
    """Repository table rows from stored API answers ``(repo_url, body, commits_count)``.

    A renamed repository answers with its new address and owner; missing dates stay NULL.
    """
    schema = (
        "html_url string, full_name string, description string, created_at string, pushed_at string, homepage string,"
        " language string, forks_count int, stargazers_count int, owner struct<login:string>"
    )
    rows = stored.withColumn("b", F.from_json("body", schema))
    return rows.select(
        F.coalesce("b.html_url", "repo_url").alias("repo_url"), F.col("b.full_name").alias("repo_name"), "b.description",
        F.try_to_timestamp(F.col("b.created_at")).alias("date_created"),
        F.try_to_timestamp(F.col("b.pushed_at")).alias("date_last_push"), "b.homepage",
        F.col("b.language").alias("repo_language"),
        F.coalesce("b.owner.login", F.element_at(F.split("repo_url", "/"), -2)).alias("owner"),
        "b.forks_count", F.col("b.stargazers_count").alias("stars_count"), "commits_count",
    )
