"""Candidates of advisories with and without dates, near and far fixes, busy and quiet repositories."""

from __future__ import annotations

from pyspark.sql import functions as F

from vulnlake.operators import ranking as R
from vulnlake.plans import jobs

DAY = 86400
START = 1_700_000_000


def commits_of(spark, rows):
    """(name, repository, day): ids are the names in 40 characters."""
    return spark.createDataFrame([(c.ljust(40, "0"), r, START + d * DAY) for c, r, d in rows], "commit_id string, repo_url string, s long").select(
        "commit_id", "repo_url", F.timestamp_seconds("s").alias("ts"), F.lit("fix").alias("message"), F.array(F.lit("a.c")).alias("changed_files"),
        F.array(F.lit("+x")).alias("diff"))


def advisories_of(spark, rows):
    return spark.createDataFrame([(c, r, None if d is None else START + d * DAY, e) for c, r, d, e in rows], "cve_id string, repo_url string, s long, extensions array<string>").select(
        "cve_id", "repo_url", F.timestamp_seconds("s").alias("reserved"), "extensions")


def weights_of(spark, rows):
    return spark.createDataFrame([(c, f"commit::{x}", 3) for c, x in rows], "cve_id string, ref string, weight int")


def pairs(spark, advisories, commits, weights, limit=None, twin_limit=None):
    got = jobs.candidate_pairs(advisories_of(spark, advisories), commits_of(spark, commits), weights_of(spark, weights), 60, 60, limit, twin_limit)
    return {(r.cve_id, r.commit_id.rstrip("0")) for r in got.collect()}


def test_an_advisory_without_a_date_gets_its_repository(spark):
    commits = [("a1", "r", -900), ("a2", "r", 0), ("a3", "q", 0)]
    assert pairs(spark, [("c", "r", None, [])], commits, []) == {("c", "a1"), ("c", "a2")}
    assert pairs(spark, [("c", "r", None, ["py"])], commits, []) == set()
    assert pairs(spark, [("c", "r", None, [])], commits, [], limit=1) == {("c", "a2")}


def test_without_a_date_a_named_commit_is_an_anchor(spark):
    commits = [("abcdef1", "r", 0), ("b1", "r", 9), ("b2", "r", 30)]
    assert pairs(spark, [("c", "r", None, [])], commits, [("c", "abcdef1")]) == {("c", "abcdef1"), ("c", "b1")}


def test_a_named_commit_far_from_the_date_is_an_anchor(spark):
    commits = [("abcdef1", "r", 900), ("b1", "r", 905), ("b2", "r", 0), ("b3", "r", 915)]
    got = pairs(spark, [("c", "r", 0, [])], commits, [("c", "abcdef1")])
    assert got == {("c", "abcdef1"), ("c", "b1")}
    assert pairs(spark, [("c", "r", 0, [])], commits, [("c", "fffffff")]) == {("c", "b2")}  # not in the repository


def test_a_busy_fix_beside_a_quiet_one(spark):
    """600 commits on the day after one fix, 5 around the other: all of them are candidates."""
    commits = [(f"d{i:03d}e", "r", 1) for i in range(600)] + [("abcdef1", "r", 0), ("abcdef2", "r", 300)] + [(f"e{i}f", "r", 301) for i in range(4)]
    named = [("c", "abcdef1"), ("c", "abcdef2")]
    assert len(pairs(spark, [("c", "r", 0, [])], commits, named)) == 606
    narrowed = pairs(spark, [("c", "r", 0, [])], commits, named, twin_limit=500)
    assert len(narrowed) == 606  # no window of the busy fix is small enough, so the date window gives what it has


def test_named_commits_without_usable_files_are_added(spark):
    commits = commits_of(spark, [("abcdef1", "r", 5)]).withColumn("changed_files", F.array(F.lit("README"))).unionByName(commits_of(spark, [("b1", "r", 0)]))
    got = jobs.candidate_pairs(advisories_of(spark, [("c", "r", 0, [])]), commits, weights_of(spark, [("c", "abcdef1")]), 60, 60, None)
    assert {r.commit_id.rstrip("0") for r in got.collect()} == {"abcdef1", "b1"}


def test_ranking_is_narrow_and_details_come_back(spark, rows):
    commits = commits_of(spark, [("abcdef1", "https://github.com/apache/r", 0), ("b1", "https://github.com/apache/r", 1)]).withColumn(
        "message", F.when(F.col("commit_id").startswith("a"), "fixes CVE-2024-1000, see AMQ-7 and #5").otherwise("other"))
    advisories = advisories_of(spark, [("CVE-2024-1000", "https://github.com/apache/r", None, [])]).withColumns({
        "keywords": F.array(F.lit("other")), "files": F.array(F.lit("Main")),
        "references": F.create_map(F.lit("https://issues.example.org/jira/AMQ-7"), F.lit(2))})
    page = "repository string, issue_id string, content string"
    tickets = spark.createDataFrame([("https://github.com/apache/r", "AMQ-7", "about CVE-2024-1000 attack")], page)
    issues = spark.createDataFrame([("https://github.com/apache/r", "5", "security")], page)
    kept, twins = jobs.rank_candidates(advisories, commits, weights_of(spark, [("CVE-2024-1000", "abcdef1")]), issues, tickets)
    assert not {"diff", "message"} & set(kept.columns) and twins.count() == 0
    got = {r.commit_id[0]: ([m.id for m in r.matched_rules], r.relevance, r["rank"]) for r in kept.collect()}
    assert got["a"] == (["VULN_ID_IN_MESSAGE", "VULN_ID_IN_LINKED_ISSUE", "XREF_BUG", "SEC_KEYWORDS_IN_LINKED_BUG", "SEC_KEYWORDS_IN_LINKED_GH", "BUG_IN_MESSAGE", "GITHUB_ISSUE_IN_MESSAGE"], 140, 1)
    assert got["b"] == (["ADV_KEYWORDS_IN_MSG"], 4, 2)
    details = jobs.commit_details(kept, commits, issues, tickets)
    reports = R.report_rows(details, advisories.select("cve_id", "repo_url"), twins, with_diff=True)
    assert [c.jira_refs for c in reports.first().commits] == [{"AMQ-7": "about CVE-2024-1000 attack"}, {}]


def test_pending_pairs_are_ranked_to_their_end(spark, rows, tmp_path):
    from vulnlake import constants as K
    from vulnlake.operators.store import Store
    from vulnlake.plans import pending as P

    repo, gone = "https://github.com/o/r", "https://github.com/o/gone"
    commits = commits_of(spark, [("abcdef1", repo, 0), ("b1", repo, 1)]).withColumn("message", F.when(F.col("commit_id").startswith("a"), "fixes CVE-2024-1000").otherwise("other"))
    advisories = advisories_of(spark, [("CVE-2024-1000", repo, 0, []), ("CVE-2024-2000", repo, 900, [])]).withColumns({
        "keywords": F.array().cast("array<string>"), "files": F.array().cast("array<string>"),
        "references": F.create_map(F.lit("https://x"), F.lit(2))})
    page = spark.createDataFrame([], "repository string, issue_id string, content string")
    fixes = spark.createDataFrame([], "cve_id string, repo_url string, hash string")
    states = spark.createDataFrame([(repo, "Available")], "project_url string, repo_state string")
    store = Store(spark, str(tmp_path))
    P.enter_pairs(store, spark.createDataFrame(
        [("CVE-2024-1000", repo, "X", "False"), ("CVE-2024-2000", repo, "X", "False"), ("CVE-2024-2000", gone, "X", "False")],
        "cve string, project_url string, rel_type string, checked string"), buckets=2)
    rank = P.candidate_ranking(advisories, commits, weights_of(spark, []), page, page, fixes, states)
    P.run_pending(store, rank, "w")
    assert rows(store.read("cve_project"), "cve", "project_url", "checked") == [
        ("CVE-2024-1000", repo, K.PAIR_FIX_FOUND), ("CVE-2024-2000", gone, K.PAIR_REPO_REMOVED), ("CVE-2024-2000", repo, K.PAIR_NO_FIX_FOUND)]
    assert [(r.cve, r.hash[:7], r.score) for r in store.read("candidates").collect()] == [("CVE-2024-1000", "abcdef1", 64)]
