"""Cases that once lost or showed rows they should not have."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from vulnlake.operators import candidates as C
from vulnlake.operators import rules as RU
from vulnlake.operators import twins as TW
from vulnlake.operators.store import Store
from vulnlake.plans import jobs

START = 1_700_000_000


def commit_rows(spark, rows):
    return spark.createDataFrame(rows, "commit_id string, repo_url string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_ids_of_six_characters_and_more_are_found(spark):
    full = "abcdef0123456789abcdef0123456789abcdef01"
    commits = commit_rows(spark, [(full, "r", START)])
    advisories = spark.createDataFrame([(f"c{n}", "r", START) for n in (6, 7, 8, 40)], "cve_id string, repo_url string, s long").select(
        "cve_id", "repo_url", F.timestamp_seconds("s").alias("reserved"))
    refs = spark.createDataFrame([(f"c{n}", "commit::" + full[:n]) for n in (6, 7, 8, 40)], "cve_id string, ref string")
    assert {r.cve_id for r in C.mentioned(refs, advisories, commits).collect()} == {"c6", "c7", "c8", "c40"}


def test_busy_repository_keeps_its_candidates(spark):
    """600 commits a day from the fix: no window is small enough, so the date window gives the candidates, uncut."""
    rows = [(f"{i:040x}", "r", START + 86400) for i in range(600)] + [("f" * 40, "r", START)]
    commits = commit_rows(spark, rows).withColumns({
        "message": F.lit("fix"), "changed_files": F.array(F.lit("a.c")), "diff": F.array(F.lit("+x"))})
    assert C.twin_window(
        spark.createDataFrame([("c", "r", START)], "cve_id string, repo_url string, s long").select(
            "cve_id", "repo_url", F.timestamp_seconds("s").alias("author_ts"), F.timestamp_seconds("s").alias("commit_ts")), commits).count() == 0
    advisories = spark.createDataFrame([("c", "r", START)], "cve_id string, repo_url string, s long").select(
        "cve_id", "repo_url", F.timestamp_seconds("s").alias("reserved"), F.array().cast("array<string>").alias("extensions"))
    weights = spark.createDataFrame([("c", "commit::" + "f" * 40, 3)], "cve_id string, ref string, weight int")
    assert jobs.candidate_pairs(advisories, commits, weights, 60, 60, None).count() == 601
    assert jobs.candidate_pairs(advisories, commits, weights, 60, 60, 10).filter("position <= 10").count() == 10


def test_twins_go_in_rank_order_whatever_the_size(spark):
    random.seed(4)
    bands = [("v", "r", f"c{i:04d}", f"b{random.randrange(900)}") for i in range(1500) for _ in range(2)]
    ranked = [("v", "r", f"c{i:04d}", i + 1) for i in range(1510)]
    kept, seen = set(), set()
    keys = {}
    for _, _, c, b in bands:
        keys.setdefault(c, set()).add(b)
    for _, _, c, _ in ranked:
        if not keys.get(c, set()) & seen:
            kept.add(c)
            seen |= keys.get(c, set())
    got = TW.remove_twins(
        spark.createDataFrame(ranked, "cve_id string, repo_url string, commit_id string, rank int"),
        spark.createDataFrame(bands, "cve_id string, repo_url string, commit_id string, band_key string").distinct(),
        ["cve_id", "repo_url"], "commit_id", "rank")
    assert {r.commit_id for r in got.collect()} == kept


def test_two_pages_for_one_issue_do_not_stop_the_job(spark):
    commits = spark.createDataFrame([("c", "r", ["1", "1", "2"])], "commit_id string, repository string, ids array<string>")
    pages = spark.createDataFrame([("r", "1", "a"), ("r", "1", "b")], "repository string, issue_id string, content string")
    assert RU._linked(commits, "ids", pages, "linked").first()["linked"] == {"1": "b", "2": ""}


def test_store_shows_committed_tables_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.commit({"a": spark.range(1), "b": spark.range(2)})
    spark.range(99).write.parquet(f"{tmp_path}/s/a/left-by-a-dead-job")
    store.commit({"b": spark.range(3)})
    assert (store.count("a"), store.count("b")) == (1, 3)
    (tmp_path / "s/_current/3").write_text('{"a": ')  # a writer that died over its list
    assert store.count("b") == 3
    store.append("a", spark.range(5, 7), unique=["id"])
    assert store.count("a") == 3
    with pytest.raises(ValueError, match="not unique"):
        store.append("a", spark.range(1), unique=["id"])
    assert store.count("a") == 3
    store.drop("b")
    assert not store.exists("b") and store.count("b") == 0


def test_an_older_record_that_comes_late_does_not_win(spark, tmp_path):
    from vulnlake.streaming.feeds import follow_feed

    schema = spark.createDataFrame([], "id string, modified string, text string").schema
    landing = tmp_path / "in"
    landing.mkdir()

    def follow():
        follow_feed(spark, str(landing), schema, str(tmp_path / "s"), "cve", str(tmp_path / "cp"), ["id"], "modified").awaitTermination()

    (landing / "1.json").write_text('{"id": "a", "modified": "2024-02-01 00:00:00", "text": "new"}')
    follow()
    (landing / "2.json").write_text('{"id": "a", "modified": "2023-01-01 00:00:00", "text": "old"}\n{"id": "b", "modified": "2023-01-01 00:00:00", "text": "b"}')
    follow()
    assert {r.id: r.text for r in Store(spark, str(tmp_path / "s")).read("cve").collect()} == {"a": "new", "b": "b"}


def test_blacklist_is_plain():
    from vulnlake import constants as K

    assert all(re.fullmatch(r"\S+", n) for n in K.BLACKLIST_NAMES) and "oss-fuzz-vulns" in K.BLACKLIST_NAMES
