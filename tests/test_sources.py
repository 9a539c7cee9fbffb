import gzip
import json

from pyspark.sql import functions as F

from vulnlake import schema as S
from vulnlake.operators.store import Store
from vulnlake.plans import jobs as J
from vulnlake.sources import feeds, history, pages
from vulnlake.streaming.feeds import follow_feed


def nvd_file(path):
    m30 = {"cvssData": {"vectorString": "v30", "baseScore": 5.0, "scope": "U"}, "exploitabilityScore": 1.5, "impactScore": 2.0}
    m31 = {"cvssData": {"vectorString": "v31", "baseScore": 7.5}, "exploitabilityScore": None, "impactScore": 3.0}
    match = {"vulnerable": True, "criteria": "cpe:2.3:a:ven\\/dor:prod:1.0:*"}
    body = {
        "id": "CVE-2020-0001", "published": "2020-01-02T03:04:05.678", "lastModified": "2020-02-02T00:00:00.000",
        "descriptions": [{"lang": "en", "value": "d's \"x\""}],
        "metrics": {"cvssMetricV30": [m30], "cvssMetricV31": [m31], "cvssMetricV2": [{"cvssData": {"accessVector": "NETWORK", "baseScore": 4.0}}]},
        "references": [{"url": "https://github.com/o/r/commit/abcdef1"}, {"url": "https://e.org"}],
        "weaknesses": [{"description": [{"lang": "en", "value": "CWE-252"}]}],
        "configurations": [{"nodes": [{"cpeMatch": [match]}, {"cpeMatch": [{"vulnerable": True, "criteria": "cpe:2.3:a:x:y:2"}]}]}],
    }
    with gzip.open(path, "wt") as f:
        json.dump({"vulnerabilities": [{"cve": body}, {"cve": {"id": "CVE-2020-0002"}}]}, f)


def test_nvd_feed_to_tables(spark, rows, tmp_path):
    nvd_file(tmp_path / "nvd-2020.json.gz")
    cve = feeds.flatten_cve(feeds.read_nvd(spark, str(tmp_path)))
    r = cve.filter("cve_id = 'CVE-2020-0001'").first()
    assert (r.cvss3_vector_string, r.cvss3_scope, r.cvss3_base_score, r.cvss3_exploitability_score, r.cvss3_impact_score) == ("v31", "U", 7.5, None, 3.0)
    assert (r.cvss2_access_vector, r.description) == ("NETWORK", "d's \"x\"")
    assert rows(feeds.weaknesses(cve)) == [("CVE-2020-0001", "CWE-252"), ("CVE-2020-0002", "NVD-CWE-noinfo")]
    assert rows(feeds.cpe_names(cve)) == [("CVE-2020-0001", "ven/dor:prod")]
    assert feeds.cpe_names(cve, all_nodes=True).count() == 2
    packages = spark.createDataFrame([], "ecosystem string, name string, repo_url string")
    fixes, projects = J.link_references(cve, packages)
    assert rows(fixes, "cve_id", "hash", "score") == [("CVE-2020-0001", "abcdef1", 1337)]
    assert projects.count() == 0


def test_cwe_catalogue(spark, tmp_path):
    (tmp_path / "c.xml").write_text(
        '<W><Weaknesses><Weakness ID="102" Name="Struts: Duplicate Validation Forms"><Description>d</Description>'
        "<Extended_Description><p>long <b>text</b></p></Extended_Description></Weakness></Weaknesses>"
        '<Categories><Category ID="16" Name="Configuration"><Summary>s</Summary></Category></Categories></W>')
    got = {r.cwe_id: r for r in feeds.read_cwe(spark, str(tmp_path / "c.xml")).collect()}
    assert set(got) == {"CWE-102", "CWE-16", "NVD-CWE-noinfo", "NVD-CWE-Other", "NVD-CWE-1026"}
    assert got["CWE-102"].url.endswith("/102.html") and got["CWE-102"].extended_description == "long text"
    assert got["CWE-16"].is_category


def test_advisories(spark, rows, tmp_path):
    (tmp_path / "2020/01").mkdir(parents=True)
    one = {"id": "GHSA-1", "aliases": ["CVE-2020-1", "X"], "references": [{"url": "https://github.com/o/r/commit/abcdef1"}]}
    two = {"id": "GHSA-2", "aliases": ["CVE-2020-2"], "references": [], "affected": [{"package": {"ecosystem": "pip", "name": "p"}}]}
    for n, a in enumerate((one, two, {"id": "GHSA-3", "aliases": []})):
        (tmp_path / f"2020/01/{n}.json").write_text(json.dumps(a))
    advisories = feeds.read_advisories(spark, str(tmp_path))
    packages = spark.createDataFrame([("PYPI", "p", "https://github.com/q/p")], "ecosystem string, name string, repo_url string")
    fixes, projects = J.link_advisories(advisories, packages)
    assert rows(fixes, "cve_id", "hash", "rel_type") == [("CVE-2020-1", "abcdef1", "GHSD_DIRECT_COMMIT")]
    assert rows(projects, "cve", "project_url", "rel_type") == [("CVE-2020-2", "https://github.com/q/p", "GHSD_REGISTRY")]


def test_git_log(spark, tmp_path):
    sep = "-@-@-@-@-"
    log = "".join(
        f"\n{sep}\n{c}:{100 + i}:{p}\n{sep}\n{m}\n{sep}\n\n{f}"
        for i, (c, p, m, f) in enumerate([("a" * 40, "b" * 40 + " " + "c" * 40, "merge\n\nx", ""), ("d" * 40, "", "fix\nmore", "a.c\nb.c\n"), ("e" * 40, "a" * 40, "", "z\n")]))
    (tmp_path / "r.log").write_text(log)
    got = {r.commit_id[0]: r for r in history.read_git_log(spark, str(tmp_path)).collect()}
    assert got["a"].parent_id == "b" * 40 and got["a"].message == "merge x" and got["a"].changed_files == []
    assert got["d"].changed_files == ["a.c", "b.c"] and got["d"].timestamp == 101
    assert got["e"].message == ""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        again = {r.commit_id[0]: r for r in history.read_git_log(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {k: (v.message, v.changed_files) for k, v in again.items()} == {k: (v.message, v.changed_files) for k, v in got.items()}


def test_patches_reports_and_small_files(spark, rows, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.patch").write_text("x" * 10)
    (tmp_path / "p/b.patch").write_text("x" * 50)
    assert rows(history.read_patches(spark, str(tmp_path / "p"), cap=20), "file") == [("a.patch",)]
    assert rows(history.stored_patches(spark, str(tmp_path / "p"))) == [("a.patch",), ("b.patch",)]
    rules = [{"id": "X", "message": "", "relevance": 8}]
    report = {"commits": [{"commit_id": f"c{i}", "matched_rules": rules if i != 1 else [], "twins": []} for i in range(12)]}
    (tmp_path / "r.json").write_text(json.dumps(report))
    assert history.read_reports(spark, str(tmp_path / "r.json"), 10).count() == 9
    assert history.read_reports(spark, str(tmp_path / "r.json")).count() == 11
    (tmp_path / "t.csv").write_text("head;x;y;z;c\nCVE-2020-1234;r;v;t;abc\n")
    assert rows(history.read_truth(spark, str(tmp_path / "t.csv")), "cve_id", "commits") == [("CVE-2020-1234", "abc")]
    (tmp_path / "m.json").write_text(json.dumps({"p": {"git": "g", "search keywords": ["a", "b"]}}))
    assert rows(history.read_project_keywords(spark, str(tmp_path / "m.json"))) == [("p", "g", "a"), ("p", "g", "b")]
    tickets = spark.createDataFrame([("A-1", "<rss><item><summary>s</summary><description>d &lt;b&gt;x&lt;/b&gt;</description></item></rss>")], "issue_id string, xml string")
    assert rows(pages.ticket_text(tickets)) == [("A-1", "d x s")]


def test_feed_stream_equals_batch(spark, rows, tmp_path):
    landing, root = tmp_path / "in", str(tmp_path / "db")
    landing.mkdir()
    schema = S.struct(cve_id=S.STRING, modified=S.STRING, text=S.STRING)

    def run(name, *records):
        (landing / name).write_text("\n".join(json.dumps(r) for r in records))
        follow_feed(spark, str(landing), schema, root, "cve", str(tmp_path / "cp"), ["cve_id"], "modified").awaitTermination()

    run("1.json", {"cve_id": "a", "modified": "2020-01-01", "text": "old"}, {"cve_id": "b", "modified": "2020-01-01", "text": "b"})
    run("2.json", {"cve_id": "a", "modified": "2020-01-03", "text": "new"}, {"cve_id": "a", "modified": "2020-01-02", "text": "mid"})
    assert rows(Store(spark, root).read("cve"), "cve_id", "text") == [("a", "new"), ("b", "b")]


def test_change_tables(spark, rows):
    diff = "@@ -2,2 +2,2 @@\n a\n-old\n+new\n"
    changes = spark.createDataFrame([("h", "https://x/r.git", "m")], "hash string, repo_url string, msg string").withColumn(
        "modified_files", F.array(F.struct(
            F.lit("a.py").alias("old_path"), F.lit("a.py").alias("new_path"), F.lit(diff).alias("diff"), F.lit(1).alias("num_lines_added"),
            F.lit(1).alias("num_lines_deleted"), F.lit("1\n2\nnew\n4").alias("code_after"), F.lit("1\n2\nold\n4").alias("code_before"))))
    spans = spark.createDataFrame(
        [("h", "a.py", "a.py", s, n, n + "()", "", a, b) for s in ("added", "deleted") for n, a, b in (("f", 2, 4), ("g", 59, 65), ("(anonymous)", 1, 9))],
        "hash string, old_path string, new_path string, side string, name string, signature string, parameters string, start_line int, end_line int")
    out = J.build_change_tables(changes, spans)
    assert rows(out["method_change"], "name", "before_change", "code") == [("f", False, "2\nnew\n4"), ("f", True, "2\nold\n4")]
    assert rows(out["file_change"], "programming_language") == [("Python",)]
    assert rows(out["commits"], "repo_url") == [("https://x/r",)]
