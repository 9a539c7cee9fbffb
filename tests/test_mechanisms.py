"""Indexes, carried records, token distances, twin propagation and streamed reports against plain counterparts."""

from __future__ import annotations

import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from vulnlake import schema as S
from vulnlake.functions import similarity as SIM
from vulnlake.operators import candidates as C
from vulnlake.operators import links as L
from vulnlake.operators import ranking as R
from vulnlake.operators import rules as RU
from vulnlake.operators import twins as TW
from vulnlake.plans import jobs as J
from vulnlake.sources import exports, feeds, history


# ---- sources


def test_one_year_opens_one_folder(spark, rows, tmp_path):
    cve = spark.createDataFrame([(f"CVE-{y}-{i}", f"t{y}{i}") for y in (2019, 2020, 2021) for i in range(5)] + [("odd", "x")], "cve_id string, text string")
    exports.write_by_year(cve, str(tmp_path / "y"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        def opened(df):
            leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
            df.collect()
            return sum(leaves.apply(i).metrics().get("numPartitions").get().value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numPartitions"))

        one = feeds.read_years(spark, str(tmp_path / "y"), cve.schema, [2020])
        assert opened(one) == 1 and one.count() == 5
        assert opened(feeds.read_years(spark, str(tmp_path / "y"), cve.schema)) == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    asked = spark.createDataFrame([("CVE-2021-3",), ("CVE-2021-99",), ("odd",), (None,)], "cve_id string")
    assert rows(feeds.records_of(spark, str(tmp_path / "y"), cve.schema, asked)) == [("CVE-2021-3", "t20213"), ("odd", "x")]


def log_parts(commits):
    """Header, message and file list of each commit, as the parts of a log."""
    return [p for c, m, f in commits for p in (f"\n{c}:1:\n", f"\n{m}\n", f"\n{f}\n")]


def parsed(spark, splits):
    rows = [("log", block * 100, block * 1000 + i, p) for block, parts in enumerate(splits) for i, p in enumerate(parts)]
    df = spark.createDataFrame(rows, "file string, _block long, _id long, value string")
    return {r.commit_id[0]: (r.message, r.changed_files) for r in history.parse_log_parts(df).collect()}


def test_a_header_is_carried_over_any_number_of_splits(spark):
    parts = log_parts([("a" * 40, "m a", "a.c"), ("b" * 40, "m b", "b.c")])
    assert parsed(spark, [parts[:4], [parts[4]], [], [parts[5]]])["b"] == ("m b", ["b.c"])
    want = {"a": ("m a", ["a.c"]), "b": ("m b", ["b.c"])}
    random.seed(1)
    more = log_parts([(c * 40, f"m {c}", f"{c}.c\n{c}.h") for c in "abcdef"])
    for _ in range(12):
        cuts = sorted(random.choices(range(len(parts) + 1), k=3))
        assert parsed(spark, [parts[a:b] for a, b in zip([0, *cuts], [*cuts, len(parts)])]) == want
    singles = parsed(spark, [[p] for p in more])
    assert singles == {c: (f"m {c}", [f"{c}.c", f"{c}.h"]) for c in "abcdef"}


def test_product_links_keep_their_list_order(spark, rows, tmp_path):
    refs = [{"ref": "https://b"}, {"ref": "https://a"}, {"ref": "https://b"}]
    products = {"products": [{"cpe": {"cpeName": "cpe:2.3:a:ven:prod:1:*", "refs": refs}}, {"cpe": {"cpeName": "", "refs": refs}}]}
    (tmp_path / "cpe.json").write_text(json.dumps(products))
    assert rows(feeds.read_cpe(spark, str(tmp_path)), "cpe_name", "url", "pos") == [("ven:prod", "https://a", 1), ("ven:prod", "https://b", 0)]


def test_dumps_name_their_ecosystem_by_folder(spark, rows, tmp_path):
    for folder, name in (("PyPI", "one"), ("Go", "two")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / f"{name}.json").write_text(json.dumps({"id": name, "aliases": [f"CVE-2020-{len(name)}"], "references": []}))
    (tmp_path / "Go/none.json").write_text(json.dumps({"id": "GO-1", "aliases": ["GHSA-x"]}))
    assert rows(feeds.read_advisories(spark, str(tmp_path)), "folder", "id") == [("Go", "two"), ("PyPI", "one")]


def test_records_of_the_cve_list(spark, rows, tmp_path):
    def record(i, state):
        return {"cveMetadata": {"cveId": i, "state": state, "dateReserved": "2020-01-01T00:00:00", "datePublished": None},
                "containers": {"cna": {"descriptions": [{"value": "d"}], "affected": [{"product": "p", "versions": [{"version": "1"}]}], "references": [{"url": "u"}]}}}
    for n, x in enumerate((record("CVE-1", "PUBLISHED"), record("CVE-2", "REJECTED"))):
        (tmp_path / f"{n}.json").write_text(json.dumps(x))
    got = feeds.read_cve_records(spark, str(tmp_path)).collect()
    assert [(r.cve_id, r.reserved_timestamp, r.published_timestamp, r.product, r.urls) for r in got] == [("CVE-1", 1577836800, None, "p", ["u"])]


def test_feeds_become_tables(spark, rows, tmp_path):
    (tmp_path / "n").mkdir()
    body = {"id": "CVE-2020-1", "descriptions": [{"lang": "en", "value": "d"}], "weaknesses": [{"description": [{"lang": "en", "value": "CWE-1"}]}]}
    (tmp_path / "n/a.json").write_text(json.dumps({"vulnerabilities": [{"cve": body}]}))
    (tmp_path / "c.xml").write_text('<W><Weakness ID="1" Name="w"><Description>d</Description></Weakness></W>')
    tables = J.build_cve_tables(spark, str(tmp_path / "n"), str(tmp_path / "c.xml"))
    assert rows(tables["cve"], "cve_id", "description") == [("CVE-2020-1", "d")]
    assert rows(tables["cwe_classification"]) == [("CVE-2020-1", "CWE-1")]
    assert {r.cwe_id for r in tables["cwe"].collect()} > {"CWE-1", "NVD-CWE-noinfo"}


def test_repositories_of_products(spark, rows):
    dictionary = spark.createDataFrame(
        [("v:p", 0, "https://github.com/o/r/commit/abcdef1"), ("v:q", 0, "https://e.org"), ("v:q", 1, "https://github.com/o/q")], "cpe_name string, pos int, url string")
    packages = spark.createDataFrame([], "ecosystem string, name string, repo_url string")
    named = spark.createDataFrame([("c", "v:p"), ("c", "vendor:known"), ("c", "vendor:other")], "cve_id string, cpe_name string")
    known = spark.createDataFrame([("https://github.com/vendor/known",)], "repo_url string")
    got = J.link_cpe(dictionary, packages, named, known)
    assert rows(got, "cpe_name", "repo_url", "rel_type") == [
        ("v:p", "https://github.com/o/r", "DIRECT_COMMIT"), ("v:q", "https://github.com/o/q", "GIT_REPOBASED"),
        ("vendor:known", "https://github.com/vendor/known", "GITHUB_SEARCH")]


def test_newest_version_decides_the_links(spark, rows):
    releases = spark.createDataFrame([
        ("PYPI", "p", 1, "9.0", "SOURCE_REPO", "https://github.com/old/p"), ("PYPI", "p", 2, "10.0", "HOMEPAGE", "https://github.com/new/p"),
        ("RUBYGEMS", "g", 1, "1", "SOURCE_REPO", "https://github.com/a/g"), ("RUBYGEMS", "g", 2, "2", "HOMEPAGE", "https://github.com/b/g"),
    ], "ecosystem string, name string, pos int, version string, label string, url string").withColumn(
        "published", F.to_timestamp(F.concat(F.lit("2020-01-0"), F.col("pos").cast("string"))))
    assert rows(L.newest_versions(releases)) == [("PYPI", "p", "10.0"), ("RUBYGEMS", "g", "2")]
    assert rows(L.newest_versions(releases, "2020-01-01 12:00:00"), "name", "version") == [("g", "1"), ("p", "9.0")]
    assert rows(L.package_repos(releases, releases), "name", "repo_url") == [("g", "https://github.com/a/g"), ("p", "https://github.com/new/p")]
    assert rows(L.package_repos(releases, releases, "2020-01-01 12:00:00"), "name", "repo_url") == [("g", "https://github.com/a/g"), ("p", "https://github.com/old/p")]
    assert rows(L.package_repos(releases), "name", "repo_url") == [("g", "https://github.com/a/g"), ("p", "https://github.com/old/p")]


# ---- texts and tokens


def test_keywords_are_found_by_their_rarest_run(spark, rows):
    random.seed(2)
    texts = [(i, "".join(random.choices("abc d", k=random.randrange(0, 60)))) for i in range(150)] + [(900, None), (901, "ab"), (902, "größe über")]
    keywords = [(f"p{n % 9}", "".join(random.choices("abc d", k=random.randrange(0, 7)))) for n in range(60)] + [("u", "öße ü"), ("u", "nowhere"), ("n", None)]
    got = C.keyword_matches(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(keywords, "project string, keyword string"))
    assert rows(got) == sorted({(i, p) for i, t in texts for p, k in keywords if k and t and k in t}, key=repr)
    none = spark.createDataFrame([("p", "")], "project string, keyword string")
    assert C.keyword_matches(spark.createDataFrame(texts, "id int, text string"), none).count() == 0


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def osa(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            differs = a[i - 1] != b[j - 1]
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + differs)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + differs)
    return d[len(a), len(b)]


def test_distances_of_token_lists(spark):
    random.seed(3)
    pairs = [([], []), (["a"], []), ([], ["a", "b"]), (["a", "b"], ["b", "a"])]
    for _ in range(60):
        a = random.choices("abcdé", k=random.randrange(8))
        pairs.append((a, random.choices("abcdé", k=random.randrange(8))))
    long = [f"t{i}" for i in range(300)]
    pairs += [(long, [*long[:256], "t0", *long[257:]]), (long, long[::-1]), (long, [*long[:100], long[101], long[100], *long[102:]])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = {r.i: (r.lev, r.osa) for r in df.select("i", SIM.token_levenshtein(F.col("a"), F.col("b")).alias("lev"), SIM.token_damerau(F.col("a"), F.col("b")).alias("osa")).collect()}
    assert got == {i: (lev(a, b), osa(a, b)) for i, (a, b) in enumerate(pairs)}


@pytest.mark.parametrize("distance", [0, 1, 3])
def test_close_token_lists_lose_no_pair(spark, rows, distance):
    random.seed(4)
    lists = [random.choices(["a", "b", "c", "d", "e", "f", "g"], weights=[9, 5, 3, 2, 1, 1, 1], k=random.randrange(0, 9)) for _ in range(120)]
    left, right = list(enumerate(lists[:70])), list(enumerate(lists[50:]))
    got = SIM.close_token_lists(
        spark.createDataFrame(left, "left_id int, tokens array<string>"), spark.createDataFrame(right, "right_id int, tokens array<string>"), distance)
    assert rows(got, "left_id", "right_id", "levenshtein") == sorted(((i, j, lev(a, b)) for i, a in left for j, b in right if lev(a, b) <= distance), key=repr)


# ---- twins and rules


def band_rows(spark, members):
    return spark.createDataFrame([("r", c, b) for b, cs in members.items() for c in cs], "repository string, commit_id string, band_key string")


MEMBERS = {"b1": ["c1", "c2", "c3"], "b2": ["c3", "c4"], "b3": ["c5"], "b4": ["c1", "c2"], "b5": ["c6", "c7"]}


def twins_of(c):
    return {x for cs in MEMBERS.values() if c in cs for x in cs} - {c}


def test_flags_reach_twins_through_band_rows(spark, rows):
    flagged = [("v1", "c1"), ("v1", "c5"), ("v2", "c3"), ("v2", "c4"), ("v3", "c9")]
    got = TW.twins_of_flagged(spark.createDataFrame([(v, "r", c) for v, c in flagged], "cve_id string, repository string, commit_id string"),
                              band_rows(spark, MEMBERS), ["cve_id"], ["repository"], "commit_id")
    want = {(v, c) for v in ("v1", "v2", "v3") for c in [f"c{i}" for i in range(1, 10)] if any((v, t) in flagged for t in twins_of(c))}
    assert rows(got, "cve_id", "commit_id") == sorted(want)


def test_rules_about_mentions_of_commits_and_twins(spark):
    ids = {f"c{i}": f"{i}" * 40 for i in range(1, 8)}
    bands = band_rows(spark, {b: [ids[c] for c in cs] for b, cs in MEMBERS.items()})
    pairs = spark.createDataFrame(
        [("v1", "r", ids[c], "fix GHSA-ab12-cd34-ef56" if c == "c7" else "fix", {f"https://x/{ids['c1'][:12]}": 2, "https://y": 1}) for c in ids],
        "cve_id string, repository string, commit_id string, message string, references map<string,int>")
    scored = RU.apply_rules(RU.with_twin_mentions(pairs, bands), ["ALL"], RU.OPTIONAL_RULES)
    got = {r.commit_id[0]: ([m.id for m in r.matched_rules], r.relevance) for r in scored.collect()}
    assert got == {"1": (["COMMIT_IN_ADVISORY"], 64), "2": (["TWIN_IN_ADVISORY"], 64), "3": (["TWIN_IN_ADVISORY"], 64), "4": ([], 0),
                   "5": ([], 0), "6": ([], 0), "7": (["ADVISORY_PAGE_IN_MESSAGE"], 16)}
    messages = {m.id: m.message for r in scored.collect() for m in r.matched_rules}
    assert messages["TWIN_IN_ADVISORY"] == "A twin of this commit is mentioned in the advisory page"


def test_commits_of_a_tag_know_the_tags_of_their_twins(spark, rows):
    tags = {"c1": ["v1", "v2"], "c2": ["v2", "v1"], "c3": [], "c4": ["v3"], "c5": ["v1"], "c6": ["v1"]}
    commits = spark.createDataFrame([("r", c, t) for c, t in tags.items()], "repository string, commit_id string, tags array<string>")
    got = TW.tagged_commits(commits, band_rows(spark, MEMBERS), ["repository"], "commit_id", F.lit("v1"))
    want = [("r", c, "v1", sorted({(tags[t] or ["no-tag"])[0] for t in twins_of(c) if t in tags})) for c in tags if "v1" in tags[c]]
    assert rows(got) == sorted(want, key=repr)


def test_irrelevant_files(spark):
    names = ["src/test/a.c", "README", "docs/x.c", "a/docs/x.c", "src/main.c", "x.md.c", "CHANGES.c", "lib.utf8x", ""]
    df = spark.createDataFrame([(n,) for n in names], "f string")
    assert [r.f for r in df.filter(~C.is_irrelevant(F.col("f"))).collect()] == ["docs/x.c", "src/main.c", ""]
    assert df.agg(C.relevant_files(F.collect_list("f")).alias("x")).first().x == ["docs/x.c", "src/main.c", ""]


# ---- reports


def test_reports_are_streamed_with_parameters(spark, tmp_path):
    """20,000 commits of one pair, a thousand twins of one commit, a second repository and a pair without commits."""
    n = 20_000
    ranked = spark.range(n).select(F.lit("c1").alias("cve_id"), F.lit("https://r/1").alias("repo_url"), (F.col("id") + 1).cast("int").alias("rank"), F.format_string("%040x", F.col("id")).alias("commit_id")).unionByName(
        spark.createDataFrame([("c1", "https://r/2", 1, "x"), ("c9", "https://r/1", 1, "no advisory")], "cve_id string, repo_url string, rank int, commit_id string")).repartition(7)
    empty_map = F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>"))
    ranked = ranked.withColumns({
        "relevance": F.lit(8), "message": F.lit('say "hi"\nthere'), "changed_files": F.array(F.lit("f")), "cve_refs": F.array(F.lit("c")),
        "ghissue_refs": empty_map, "jira_refs": empty_map,
        "matched_rules": F.array(F.struct(F.lit("X").alias("id"), F.lit("m").alias("message"), F.lit(8).alias("relevance")))})
    twins = spark.range(1000).select(F.lit("c1").alias("cve_id"), F.lit("https://r/1").alias("repo_url"), F.format_string("%040x", F.lit(5)).alias("commit_id"), F.concat(F.lit('t"'), F.col("id").cast("string")).alias("twin"))
    advisories = spark.createDataFrame([("c1", "https://r/1", "text"), ("c1", "https://r/2", None), ("c2", "https://r/1", "none")], "cve_id string, repo_url string, `de.scription` string")
    R.write_reports(ranked, advisories, twins, str(tmp_path / "r"), {"limit": None, "rules": ["ALL"], "before": 60})
    files = sorted(glob.glob(f"{tmp_path}/r/*/*/*.txt"))
    assert len(files) == 3
    reports = [json.loads(open(f).read()) for f in files]
    assert all(r["parameters"] == {"limit": None, "rules": ["ALL"], "before": 60} for r in reports)
    big = max(reports, key=lambda r: len(r["commits"]))
    assert [c["rank"] for c in big["commits"]] == list(range(1, n + 1)) and big["advisory_record"]["de.scription"] == "text"
    assert big["commits"][5]["twins"] == sorted(f't"{i}' for i in range(1000)) and big["commits"][6]["twins"] == []
    assert big["commits"][0]["message"] == 'say "hi"\nthere' and big["commits"][0]["matched_rules"][0]["id"] == "X"
    assert sorted(len(r["commits"]) for r in reports) == [0, 1, n]
    again = history.read_reports(spark, f"{tmp_path}/r/*/*")
    assert again.count() == n + 1


def test_reports_keep_their_schema():
    assert {"commits"} == set(S.REPORT.names)


# ---- keyed


def test_rows_with_maps_and_missing_dates_have_a_first_and_a_top(spark, rows):
    from vulnlake.operators.keyed import first_per_key, top_k_per_key

    df = spark.createDataFrame([("a", None, {"x": 1}), ("a", 2, {"y": 1}), ("a", 3, {}), ("b", None, {"z": 1})], "k string, v int, m map<string,int>")
    assert rows(first_per_key(df, ["k"], [F.col("v")]), "k", "v") == [("a", 2), ("b", None)]
    assert rows(first_per_key(df.drop("m"), ["k"], [-F.col("v")])) == [("a", 3), ("b", None)]
    assert rows(top_k_per_key(df, ["k"], [F.desc("v")], 1), "k", "v", "rank") == [("a", 3, 1), ("b", None, 1)]
