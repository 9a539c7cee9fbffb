"""The analyses users run on the finished tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.urls import any_of, last_part
from vulnlake.operators.keyed import with_position
from vulnlake.operators.products import ProductPairs
from vulnlake.session import cut_lineage


def single_line_fixes(files: DataFrame, commits: DataFrame, fixes: DataFrame, cve: DataFrame, cwe: DataFrame) -> DataFrame:
    """Files of fixes with at most one line added and removed, with CVE and weakness."""
    small = files.filter((F.col("num_lines_added") <= 1) & (F.col("num_lines_deleted") <= 1))
    return (
        small.join(commits.select("hash"), "hash")
        .join(fixes.select("hash", "cve_id"), "hash")
        .join(cve.select("cve_id"), "cve_id")
        .join(cwe.select("cve_id", "cwe_id"), "cve_id")
        .select("cve_id", "filename", "num_lines_added", "num_lines_deleted", "cwe_id")
    )


def _per_hash(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("hash").agg(F.count("*").alias(name))


def commit_frequency(fixes: DataFrame, commits: DataFrame) -> DataFrame:
    """Fix-commit matches per repository.

    Both sides are counted per hash before they meet, so a hash with many fixes and many commits is one row
    of a product and never a block of joined rows.
    """
    fix = fixes.groupBy("repo_url", "hash").agg(F.count("*").alias("_f"))
    return (
        fix.join(_per_hash(commits, "_c"), "hash")
        .groupBy(F.col("repo_url").alias("commit_project"))
        .agg(F.sum(F.col("_f") * F.col("_c")).alias("commit_count"))
    )


def file_frequency(fixes: DataFrame, commits: DataFrame, files: DataFrame) -> DataFrame:
    """Fix-commit-file matches per repository."""
    fix = fixes.groupBy("repo_url", "hash").agg(F.count("*").alias("_f"))
    return (
        fix.join(_per_hash(commits, "_c"), "hash").join(_per_hash(files, "_n"), "hash")
        .groupBy(F.col("repo_url").alias("file_project"))
        .agg(F.sum(F.col("_f") * F.col("_c") * F.col("_n")).alias("file_count"))
    )


def method_frequency(fixes: DataFrame, commits: DataFrame, files: DataFrame, methods: DataFrame) -> DataFrame:
    """Fix-commit-file-method matches per repository."""
    per_file = methods.groupBy("file_change_id").agg(F.count("*").alias("_m"))
    per_hash = files.select("hash", "file_change_id").join(per_file, "file_change_id").groupBy("hash").agg(
        F.sum("_m").alias("_m")
    )
    fix = fixes.groupBy("repo_url", "hash").agg(F.count("*").alias("_f"))
    return (
        fix.join(_per_hash(commits, "_c"), "hash").join(per_hash, "hash")
        .groupBy(F.col("repo_url").alias("method_project"))
        .agg(F.sum(F.col("_f") * F.col("_c") * F.col("_m")).alias("method_count"))
    )


def frequencies(
    fixes: DataFrame, commits: DataFrame, files: DataFrame, methods: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """:func:`commit_frequency`, :func:`file_frequency` and :func:`method_frequency` in one pass.

    Files are counted once, with their methods; fixes meet the counts of their hash once.  Only the sums, a row for each
    repository, are kept for the three lists.  A repository is in a list if any of its fixes has a match.
    """
    per_method = methods.groupBy("file_change_id").agg(F.count("*").alias("_m"))
    per_file = files.select("hash", "file_change_id").join(per_method, "file_change_id", "left")
    per_hash = per_file.groupBy("hash").agg(F.count("*").alias("_n"), F.sum("_m").alias("_m"))
    stored = _per_hash(commits, "_c").join(per_hash, "hash", "left")
    fix = F.col("_c").cast("long")
    met = fixes.select("repo_url", "hash").join(stored, "hash")
    sums = cut_lineage(met.groupBy("repo_url").agg(
        F.sum(fix).alias("commit_count"), F.sum(fix * F.col("_n")).alias("file_count"), F.sum(fix * F.col("_m")).alias("method_count")))
    return tuple(
        sums.filter(F.col(f"{kind}_count").isNotNull()).select(F.col("repo_url").alias(f"{kind}_project"), f"{kind}_count")
        for kind in ("commit", "file", "method"))


def merged_frequencies(commit: DataFrame, file: DataFrame, method: DataFrame) -> DataFrame:
    """The three counts side by side for projects that have all of them."""
    return (
        commit.join(file, F.col("commit_project") == F.col("file_project"))
        .join(method, F.col("commit_project") == F.col("method_project"))
        .select(
            "commit_project", *[F.coalesce(c, F.lit(0)).cast("long").alias(c)
                                for c in ("commit_count", "file_count", "method_count")],
        )
    )


def top_projects(merged: DataFrame, n: int = 10) -> DataFrame:
    return (
        merged.withColumn("commit_project", last_part(F.col("commit_project")))
        .orderBy(F.desc("commit_count"), F.desc("file_count"), F.desc("method_count"), "commit_project")
        .limit(n)
    )


def side_by_side(commit: DataFrame, file: DataFrame, method: DataFrame) -> DataFrame:
    """The three frequency lists, each in its own order, row next to row."""
    lists = []
    for df, kind in ((commit, "commit"), (file, "file"), (method, "method")):
        project, count = f"{kind}_project", f"{kind}_count"
        lists.append(with_position(df, [F.desc(count), F.col(project)]))
    joined = reduce(lambda a, b: a.join(b, "pos", "full"), lists)
    names = [F.replace(last_part(F.col(f"{k}_project")), F.lit("_"), F.lit("-")).alias(f"{k}_project") for k in ("commit", "file", "method")]
    counts = [F.coalesce(f"{k}_count", F.lit(0)).cast("long").alias(f"{k}_count") for k in ("commit", "file", "method")]
    return joined.select("pos", *names, *counts)


def open_source_cves(fixes: DataFrame, projects: DataFrame | ProductPairs) -> DataFrame:
    """(CVE, repository) of fixes and project links, once."""
    fixed = fixes.select(F.col("cve_id").alias("cve"), F.col("repo_url").alias("url"))
    if not isinstance(projects, ProductPairs):
        return fixed.union(projects.select("cve", F.col("project_url").alias("url"))).distinct()
    # product pairs stand once each, so only the fixes outside them are looked for
    known = projects.among(fixed.withColumnRenamed("url", "project_url"))
    same = F.col("cve").eqNullSafe(F.col("_cve")) & F.col("url").eqNullSafe(F.col("_url"))
    alone = fixed.distinct().join(known.toDF("_cve", "_url"), same, "left_anti")
    return projects.rows().select("cve", F.col("project_url").alias("url")).union(alone)


def cves_of(cwe: DataFrame, cve: DataFrame, cwe_ids: list[str], phrases: list[str]) -> DataFrame:
    """CVEs of some weaknesses or with some phrase in the description."""
    by_class = cwe.filter(F.col("cwe_id").isin(cwe_ids)).select("cve_id")
    by_text = cve.filter(any_of([F.col("description").ilike(f"%{p}%") for p in phrases])).select("cve_id")
    return by_class.union(by_text).distinct()


def files_fixing(files: DataFrame, fixes: DataFrame, cves: DataFrame) -> DataFrame:
    """Files of the commits that fix some CVEs."""
    hashes = fixes.join(cves, "cve_id", "left_semi").select("hash")
    return files.join(hashes, "hash", "left_semi")


def javascript_injection_fixes(files: DataFrame, fixes: DataFrame, cwe: DataFrame, cve: DataFrame) -> DataFrame:
    phrases = ["code injection", "code execution", "command execution", "command injection"]
    hit = files_fixing(files, fixes, cves_of(cwe, cve, ["CWE-77", "CWE-94"], phrases))
    return hit.filter(
        ~F.col("new_path").ilike("%test%")
        & ((F.col("programming_language") == "JavaScript") | F.col("new_path").ilike("%.js"))
    )
