import json

from pyspark.sql import functions as F

from vulnlake.operators import ranking as R
from vulnlake.sources import exports as E


def test_exports(spark, tmp_path):
    cve = spark.createDataFrame([("CVE-2020-1", "a"), ("CVE-2021-1", "b")], "cve_id string, text string")
    E.write_by_year(cve, str(tmp_path / "y"))
    assert spark.read.schema("cve_id string, text string, year int").json(str(tmp_path / "y")).filter("year = 2021").first().text == "b"
    E.write_first_rows(cve.orderBy("cve_id"), str(tmp_path / "c"), 1)
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().cve_id == "CVE-2020-1"
    E.write_json_lines(cve, str(tmp_path / "j"))
    assert spark.read.schema("cve_id string").json(str(tmp_path / "j")).count() == 2


def test_repository_rows(spark):
    body = json.dumps({"html_url": "https://github.com/n/r", "created_at": "2020-01-01T00:00:00Z", "pushed_at": None, "owner": {"login": "n"}, "stargazers_count": 3})
    df = spark.createDataFrame([("https://github.com/o/r", body, 7), ("https://github.com/o/s", "{}", None)], "repo_url string, body string, commits_count int")
    got = {r.repo_url: r for r in E.repository_rows(df).collect()}
    assert got["https://github.com/n/r"].owner == "n" and got["https://github.com/n/r"].date_last_push is None
    assert got["https://github.com/o/s"].owner == "o"


def test_report_and_fix_statements(spark, rows):
    ranked = spark.createDataFrame([("c", "r", 1, "a", 64), ("c", "r", 2, "b", 4)], "cve_id string, repo_url string, rank int, commit_id string, relevance int")
    empty_map = F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>"))
    ranked = ranked.withColumns({
        "message": F.lit("m"), "changed_files": F.array(F.lit("f")), "cve_refs": F.array(F.lit("c")), "ghissue_refs": empty_map,
        "jira_refs": empty_map, "matched_rules": F.array().cast("array<struct<id:string,message:string,relevance:int>>")})
    twins = spark.createDataFrame([("c", "r", "a", "t")], "cve_id string, repo_url string, commit_id string, twin string")
    advisories = spark.createDataFrame([("c", "r", "text")], "cve_id string, repo_url string, description string")
    reports = R.report_rows(ranked, advisories, twins)
    assert [c.commit_id for c in reports.first().commits] == ["a", "b"]
    chosen = spark.createDataFrame([("c", "a")], "cve_id string, commit_id string")
    assert rows(R.fix_statements(reports, chosen)) == [("c", "no-tag", "a", "r"), ("c", "no-tag", "t", "r")]
