"""Pairs through shared products against plain joins, and what they send through shuffles."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vulnlake.operators.products import ProductPairs
from vulnlake.plans import analyses as A
from vulnlake.plans import jobs as J
from vulnlake.plans import pending as P


def tables(spark, seed, products=8):
    random.seed(seed)
    names = [f"p{i}" for i in range(products)] + [None]
    urls = [f"https://h/R{i}" for i in range(6)] + [None]
    cves = [f"CVE-{i}" for i in range(12)] + [None]
    projects = [(random.choice(names), random.choice(urls), random.choice(["A", "B", "C", None])) for _ in range(30)]
    mapping = [(random.choice(cves), random.choice(names)) for _ in range(40)]
    return (spark.createDataFrame(projects, "cpe_name string, repo_url string, rel_type string"),
            spark.createDataFrame(mapping, "cve_id string, cpe_name string"))


def plain(projects, mapping):
    return projects.join(mapping, "cpe_name").groupBy(F.col("cve_id").alias("cve"), F.col("repo_url").alias("project_url")).agg(
        F.min("rel_type").alias("rel_type"))


@pytest.mark.parametrize("most", [1, 2, 64])
def test_pairs_stand_once_with_their_smallest_kind(spark, rows, most):
    for seed in range(3):
        projects, mapping = tables(spark, seed)
        got = ProductPairs(projects, mapping).rows(most=most).select("cve", "project_url", "rel_type")
        assert rows(got) == rows(plain(projects, mapping))


def test_questions_about_pairs_agree_with_the_listed_pairs(spark, rows):
    projects, mapping = tables(spark, 7)
    pairs, listed = ProductPairs(projects, mapping), plain(projects, mapping)
    fixes = spark.createDataFrame(
        [(f"{random.choice(['cve', 'CVE'])}-{random.randrange(14)}", random.choice(["https://h/r", "https://h/R"]) + str(random.randrange(8)))
         for _ in range(60)] + [(None, "https://h/R1"), ("CVE-1", None)], "cve_id string, repo_url string")
    assert rows(J.fixed_pairs(pairs, fixes)) == rows(J.fixed_pairs(listed.select("cve", "project_url"), fixes))
    assert rows(A.open_source_cves(fixes, pairs)) == rows(A.open_source_cves(fixes, listed))
    assert rows(pairs.cves().distinct()) == rows(listed.select("cve").distinct())
    repos = spark.createDataFrame([("https://h/R1", "Available"), ("https://h/R2", "Unavailable")], "project_url string, repo_state string")
    found = spark.createDataFrame([(f"CVE-{i}", i) for i in range(0, 12, 3)], "cve string, n_commits long")
    assert rows(P.status_of(pairs, fixes, repos, found)) == rows(P.status_of(listed, fixes, repos, found))


def shuffled_rows(df) -> int:
    """Rows that all shuffles of a plan wrote."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of some size
    try:
        df = df.select("*")  # planned anew
        plan = df._jdf.queryExecution().executedPlan()
        df._jdf.queryExecution().toRdd().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    def walk(node):
        own = node.metrics().get("shuffleRecordsWritten")
        own = own.get().value() if node.nodeName() == "Exchange" and own.isDefined() else 0
        return own + sum(walk(node.children().apply(i)) for i in range(node.children().size()))

    sent = walk(plan)
    assert sent > 0
    return sent


def test_pairs_are_not_shuffled(spark):
    """400 CVEs and 400 projects of each of two products: 320,000 pairs, which an aggregation would send."""
    projects = spark.range(800).select((F.col("id") % 2).cast("string").alias("cpe_name"), F.col("id").cast("string").alias("repo_url"), F.lit("A").alias("rel_type"))
    mapping = spark.range(800).select(F.col("id").cast("string").alias("cve_id"), (F.col("id") % 2).cast("string").alias("cpe_name"))
    pairs = J.map_cpe_to_cve(projects, mapping)
    assert pairs.count() == 320_000
    assert shuffled_rows(pairs) < 20_000
    fixes = mapping.select("cve_id", F.col("cve_id").alias("repo_url"))
    found = mapping.select(F.col("cve_id").alias("cve"), F.lit(1).alias("n_commits"))
    repos = projects.select(F.col("repo_url").alias("project_url"), F.lit("Available").alias("repo_state"))
    both = ProductPairs(projects, mapping)
    for out in (J.fixed_pairs(both, fixes), A.open_source_cves(fixes, both), P.status_of(both, fixes, repos, found)):
        assert shuffled_rows(out) < 40_000
