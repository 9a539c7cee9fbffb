import random

from pyspark.sql import functions as F

from vulnlake.operators import candidates as C
from vulnlake.operators import links as L
from vulnlake.operators import pruning as P
from vulnlake.operators import statistics as ST
from vulnlake.operators import tables as TB
from vulnlake.operators.store import Store
from vulnlake.operators import tags as TG
from vulnlake.operators import twins as TW
from vulnlake.operators.keyed import first_per_key, top_k_per_key, with_position


def test_hot_key_first_and_top_k(spark):
    data = [("hot" if i % 3 else f"k{i}", (i * 7919) % 1009, i) for i in range(900)]
    df = spark.createDataFrame(data, "k string, v int, id int")
    first = {r.k: r.id for r in first_per_key(df, ["k"], [F.col("v")]).collect()}
    top = top_k_per_key(df, ["k"], [F.col("v"), F.col("id")], 5).collect()
    by_key = {}
    for k, v, i in data:
        by_key.setdefault(k, []).append((v, i))
    assert first == {k: min(rows)[1] for k, rows in by_key.items()}
    want = {(k, i, n) for k, rows in by_key.items() for n, (_, i) in enumerate(sorted(rows)[:5], 1)}
    assert {(r.k, r.id, r["rank"]) for r in top} == want


def test_positions_and_median(spark):
    random.seed(3)
    data = [(random.choice("aab"), float(random.randint(0, 40)), i) for i in range(501)]
    df = spark.createDataFrame(data, "p string, v double, id int")
    placed = with_position(df, [F.col("v"), F.col("id")]).collect()
    assert [r.id for r in sorted(placed, key=lambda r: r.pos)] == [i for _, _, i in sorted(data, key=lambda t: (t[1], t[2]))]
    import statistics

    got = {r.p: r.median for r in ST.exact_median(df, ["p"], "v").collect()}
    assert got == {p: statistics.median(v for q, v, _ in data if q == p) for p in "ab"}


def test_insert_ignore_is_idempotent_and_keeps_null_keys(spark, rows):
    target = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 9), ("b", 3), ("b", 2), (None, 5), (None, 5)], "k string, v int")
    once = TB.insert_ignore(target, new, ["k"], [F.col("v")])
    assert rows(once) == sorted([("a", 1), ("b", 2), (None, 5), (None, 5)], key=repr)
    keyed = new.filter("k is not null")
    assert rows(TB.insert_ignore(TB.insert_ignore(target, keyed, ["k"], [F.col("v")]), keyed, ["k"], [F.col("v")])) == [("a", 1), ("b", 2)]


def test_upsert_twice_gives_one_row(spark, rows):
    target = spark.createDataFrame([("r", 1), ("s", 2)], "repo_url string, stars int")
    new = spark.createDataFrame([("r", 5)], "repo_url string, stars int")
    again = TB.upsert(TB.upsert(target, new, ["repo_url"], [F.col("stars")]), new, ["repo_url"], [F.col("stars")])
    assert rows(again) == [("r", 5), ("s", 2)]


def test_store_moves_all_tables_together(spark, rows, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    assert not store.exists("a")
    store.commit({"a": spark.range(2), "b": spark.range(3)})
    store.commit({"a": spark.range(5)})
    assert (store.read("a").count(), store.read("b").count()) == (5, 3)


def test_best_link_prefers_commit_then_repository_then_registry(spark, rows):
    refs = spark.createDataFrame([
        ("c1", 0, "https://github.com/o/r/issues/1"), ("c1", 1, "http://github.com/o/r/commit/abc123"),
        ("c2", 0, "https://pypi.org/project/pkg/"), ("c2", 1, "https://github.com/o/exploit-poc"),
        ("c2", 2, "https://github.com/o/r/wiki"), ("c3", 0, "https://pypi.org/project/pkg/#files"),
        ("c4", 0, "https://github.com/x/cve-2020-1"), ("c5", 0, "https://example.org/a"),
    ], "cve_id string, pos int, url string")
    packages = L.package_repos(spark.createDataFrame(
        [("PYPI", "pkg", "1", "HOMEPAGE", "https://github.com/z/other"), ("PYPI", "pkg", "1", "SOURCE_REPO", "git+https://github.com/ebi/arch.git")],
        "ecosystem string, name string, version string, label string, url string"))
    assert rows(L.best_links(refs, "cve_id", packages)) == [
        ("c1", "http://github.com/o/r/commit/abc123", "DIRECT_COMMIT", 0), ("c2", "https://github.com/o/r", "GIT_REPOBASED", 1),
        ("c3", "https://github.com/ebi/arch", "REGISTRY", 0), ("c4", None, None, 1)]
    fixes, projects = L.project_links(refs, packages)
    assert rows(fixes) == [("c1", "abc123", "https://github.com/o/r", "NVD_DIRECT_COMMIT")]
    assert [r[0] for r in rows(projects)] == ["c2", "c3"]


def test_fixing_commits_match_the_raised_limit(spark):
    random.seed(5)
    weights = [(f"c{c}", f"commit::{i:040x}", random.randint(1, 4)) for c in range(30) for i in range(random.randint(0, 12))]
    got = {}
    df = spark.createDataFrame(weights, "cve_id string, ref string, weight int")
    assert L.fixing_commits(df).count() == len(weights)
    for r in L.fixing_commits(df, 5).collect():
        got.setdefault(r.cve_id, set()).add("commit::" + r.commit_id)
    for c in {w[0] for w in weights}:
        refs, limit = {r: w for k, r, w in weights if k == c}, 0
        while len(refs) > 5:
            refs = {r: w for r, w in refs.items() if w > limit}
            limit += 1
        assert got.get(c, set()) == set(refs)


def test_twins_of_copies_and_their_removal(spark):
    texts = ["fix the buffer overflow in parser"] * 40 + [f"topic {i} alpha{i} beta{i} gamma{i} delta{i}" for i in range(20)]
    commits = spark.createDataFrame([("cve", "r", f"c{i:02d}", t, i + 1) for i, t in enumerate(texts)],
                                    "cve_id string, repo_url string, commit_id string, message string, rank int")
    scope = ["cve_id", "repo_url"]
    bands = TW.band_rows(commits, scope, "commit_id", "message").persist()
    assert bands.count() == 60 * 9
    assert {r.commit_id for r in TW.with_twins(bands, scope, "commit_id").collect()} == {f"c{i:02d}" for i in range(40)}
    groups = TW.twin_groups(bands, scope, "commit_id")
    assert groups.count() == 40
    kept = TW.remove_twins(commits, bands, scope, "commit_id", "rank")
    assert {r.commit_id for r in kept.collect()} == {"c00"} | {f"c{i:02d}" for i in range(40, 60)}
    assert TW.twins_of_kept(kept, bands, scope, "commit_id").count() == 39


def test_similar_texts_match_brute_force(spark):
    random.seed(9)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(random.sample(words, random.randint(4, 10))) for _ in range(60)] + ["w1 w2 w3 w4"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = docs.withColumnRenamed("doc_id", "query_id")
    got = sum(r.n_queries * r.n_docs for r in TW.similar_texts(asked, docs).collect())
    sets = [set(t.split()) for t in texts]
    assert got == sum(len(a & b) / len(a | b) >= 0.8 for a in sets for b in sets)


def test_twin_window_narrows_until_it_is_small(spark):
    start = 1_700_000_000
    data = [(f"c{i}", "r", start + (i % 21 - 10) * 86400) for i in range(1200)]
    commits = spark.createDataFrame(data, "commit_id string, repo_url string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    fix = spark.createDataFrame([("v", "r", start)], "cve_id string, repo_url string, s long").select(
        "cve_id", "repo_url", F.timestamp_seconds("s").alias("author_ts"), F.timestamp_seconds("s").alias("commit_ts"))
    got = C.twin_window(fix, commits).select("commit_id", "width").collect()
    width = next(w for w in range(10, 1, -1) if sum(abs(s - start) <= w * 86400 for _, _, s in data) < 500)
    assert {r.width for r in got} == {width}
    assert {r.commit_id for r in got} == {c for c, _, s in data if abs(s - start) <= width * 86400}


def test_keywords_contained_in_texts(spark, rows):
    texts = spark.createDataFrame([(1, "the Django app"), (2, "go"), (3, "")], "id int, text string")
    keys = spark.createDataFrame([("p", "Django"), ("p", "app"), ("q", "go"), ("z", "jan")], "project string, keyword string")
    assert rows(C.keyword_matches(texts, keys)) == [(1, "p"), (1, "q"), (1, "z"), (2, "q")]


def test_close_tags_are_filtered_by_side_before_they_are_ranked(spark):
    names = ["1.2.30", "1.2.31", "1.2.32", "1.2.33", "1.2.34", "1.2.35", "1.2.1", "1.2.2"]
    tags = spark.createDataFrame([("r", v, f"v{v}") for v in names], "repo_url string, version_key string, tag string")
    asked = spark.createDataFrame([(1, "r", "1.2.3", "1.2.3")], "id long, repo_url string, version string, other string")
    got = {r.tag: r.rank for r in TG.close_tags(tags, asked, before=True).collect()}
    assert got == {"v1.2.2": 1, "v1.2.1": 2}
    assert {r.tag for r in TG.close_tags(tags, asked, before=True, most=1).collect()} == {"v1.2.2"}
    assert len(TG.close_tags(tags, asked, before=False).collect()) == 6


def test_tags_of_version_intervals(spark):
    names = ["0.9-beta1"] + [f"docker-plugin-0.{i}" for i in range(1, 9)] + [f"docker-plugin-1.1.{i}" for i in range(1, 10)] + ["libvirt-slave-1.7"]
    tags = spark.createDataFrame([("r", i, t) for i, t in enumerate(names)], "repo_url string, pos int, tag string")
    asked = spark.createDataFrame([(1, "r", "1.1.4:1.1.6"), (2, "r", "7.7:8.8")], "id int, repo_url string, interval string")
    got = {r.id: (r.prev_tag, r.next_tag) for r in TG.tags_of_intervals(tags, asked).collect()}
    assert got == {1: ("docker-plugin-1.1.4", "docker-plugin-1.1.6"), 2: (None, None)}


def test_prune_keeps_canonical_rows(spark, rows):
    commits = spark.createDataFrame([("h", "https://x/long", "m"), ("h", "https://x.git", "m")], "hash string, repo_url string, msg string")
    files = spark.createDataFrame([("2", "h", None, "n", "7"), ("1", "h", None, "n", "nan")],
                                  "file_change_id string, hash string, old_path string, new_path string, num_lines_added string")
    methods = spark.createDataFrame([("m1", "1", "f", "f()", "", "1", "2"), ("m2", "2", "f", "f()", "", "1", "2")],
                                    "method_change_id string, file_change_id string, name string, signature string, parameters string, start_line string, end_line string")
    out = P.prune({"commits": commits, "file_change": files, "method_change": methods})
    assert rows(out["commits"]) == [("h", "https://x", "m")]
    assert rows(out["file_change"], "file_change_id", "num_lines_added") == [("1", None)]
    assert rows(out["method_change"], "method_change_id", "file_change_id") == [("m1", "1")]
