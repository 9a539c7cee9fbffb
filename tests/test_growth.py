"""Joins that form many pairs: what is shuffled, and that nothing is lost by it."""

import re

import pytest
from pyspark.sql import functions as F

from vulnlake.functions import similarity as SIM
from vulnlake.functions import text as X
from vulnlake.operators import candidates as C
from vulnlake.operators import changes as CH
from vulnlake.operators import pruning as P
from vulnlake.operators import twins as TW
from vulnlake.plans import analyses as A


@pytest.fixture
def plan(spark):
    """The physical plan without broadcasts, one operator a line from the result down, as for large tables."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    def lines(df):
        text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        return [re.sub(r"^[\s:+*()\d-]*", "", line) for line in text.split("\n")]

    yield lines
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def above_join(lines):
    """Operators between the result and its last join, and that join."""
    at = next(i for i, line in enumerate(lines) if "Join" in line)
    return lines[:at], lines[at]


def exchanges(lines):
    return [line for line in lines if line.startswith(("Exchange", "ShuffleExchange"))]


def test_pairs_of_close_lists_are_not_shuffled(spark, plan):  # F1
    left = spark.createDataFrame([(1, ["a", "b"])], "left_id int, tokens array<string>")
    right = spark.createDataFrame([(2, ["a", "c"])], "right_id int, tokens array<string>")
    after, join = above_join(plan(SIM.close_token_lists(left, right, 1)))
    assert "_key" in join and not exchanges(after)


def test_scaled_path_scores_shuffle_pairs_once(spark, plan):  # F1
    pairs = spark.createDataFrame([("g", "a/b", "b/a")], "g string, p string, t string")
    assert len(exchanges(plan(SIM.path_similarities(pairs, "g", "p", "t")))) == 1


def test_frequent_key_is_met_in_several_places(spark, rows):  # F1
    left = spark.createDataFrame([(i, ["a", f"l{i}"]) for i in range(40)], "left_id int, tokens array<string>")
    right = spark.createDataFrame([(i, ["a", f"r{i}"]) for i in range(40)], "right_id int, tokens array<string>")
    for parts in (1, 8):
        assert rows(SIM.close_token_lists(left, right, 1, parts), "left_id", "right_id", "levenshtein") == sorted(
            ((i, j, 1) for i in range(40) for j in range(40)), key=repr)


COMMITS = [("abcdef01", "r"), ("abcdef02", "r"), ("abcdef01", "other")]


def test_references_of_two_tables_are_shuffled_once_to_the_commits(spark, rows, plan):  # F5
    asked = spark.createDataFrame([("c1", "r", "h"), ("c2", "q", "h")], "cve_id string, repo_url string, hash string").withColumn(
        "reserved", F.timestamp_seconds(F.lit(0)))
    files = spark.createDataFrame([("h", "abcdef"), ("h", "abcdef02"), ("h", "abcdef02")], "hash string, id string")
    commits = spark.createDataFrame(COMMITS, "commit_id string, repo_url string").withColumn("ts", F.timestamp_seconds(F.lit(9)))
    references = asked.join(files, "hash").select("cve_id", "repo_url", "reserved", F.concat(F.lit("commit::"), "id").alias("ref"))
    got = C.mentioned(references, None, commits)
    assert rows(got, "cve_id", "repo_url", "commit_id") == [("c1", "r", "abcdef01"), ("c1", "r", "abcdef02")]
    lines = plan(got)
    joins = [i for i, line in enumerate(lines) if "Join" in line]
    assert len(exchanges(lines[joins[0]:joins[1]])) == 1


@pytest.mark.parametrize("most", [0, 1 << 22])
def test_few_keywords_go_to_the_texts(spark, rows, plan, most):  # F16
    texts = spark.createDataFrame([(1, "hot bolt a"), (1, "tin"), (2, "cold é"), (3, ""), (4, None)], "id int, text string")
    keys = spark.createDataFrame(
        [("p", "bolt a"), ("q", "t"), ("p", "t"), ("s", "é"), ("s", "cold é "), ("n", ""), (None, "tin"), ("ab", "ol")], "project string, keyword string")
    got = C.keyword_matches(texts, keys, most=most)
    assert rows(got) == sorted([(1, "p"), (1, "q"), (1, None), (1, "ab"), (2, "s"), (2, "ab")], key=repr)
    if most:
        after, _ = above_join(plan(got))
        assert not exchanges(after)


def test_three_frequencies_agree_with_single_ones(spark, rows, plan):  # F17, F26, F27
    fixes = spark.createDataFrame([("r", "h"), ("r", "h"), ("s", "h"), ("t", "g"), ("u", "x"), (None, "h")], "repo_url string, hash string")
    commits = spark.createDataFrame([("h",), ("h",), ("g",), (None,)], "hash string")
    files = spark.createDataFrame([("h", "f1"), ("h", "f2"), ("h", "f2"), ("h", None), (None, "f1")], "hash string, file_change_id string")
    methods = spark.createDataFrame([("f1",), ("f2",), ("f2",), (None,)], "file_change_id string")
    got = A.frequencies(fixes, commits, files, methods)
    single = (A.commit_frequency(fixes, commits), A.file_frequency(fixes, commits, files), A.method_frequency(fixes, commits, files, methods))
    for one, other in zip(got, single):
        assert one.columns == other.columns and rows(one) == rows(other)
        assert not exchanges(plan(one))  # what the three share is computed once
    assert dict(rows(got[2])) == {"r": 20, "s": 10, None: 10}


IDS = ["00", "0", "", "ab", "AB", "abc", "é", "01ff", None, "00ff" * 8]


def test_packed_ids_come_back(spark):  # F21 to F24, F30
    df = spark.createDataFrame([(i,) for i in IDS], "id string").select("id", X.packed(F.col("id")).alias("p"))
    got = df.select("id", X.unpacked(F.col("p")).alias("back"), F.length("p").alias("n")).collect()
    assert [r.back for r in got] == IDS and got[-1].n == 17
    assert df.select("p").distinct().count() == len(IDS)


def test_files_are_shuffled_once_for_their_first_id(spark, rows, plan):  # F24, F30
    keyed = [(i, h, None, "n") for h in ("h", None) for i in ("b", "0a", "a", "a", "AB")] + [("z", "g", "o", "n")]
    files = spark.createDataFrame(keyed, "file_change_id string, hash string, old_path string, new_path string")
    got = P.canonical_ids(files)
    assert rows(got) == [("AB", "0a"), ("a", "0a"), ("b", "0a")]
    assert len(exchanges(plan(got))) == 2


def test_first_method_is_by_text_of_its_id(spark, rows):  # F21
    methods = spark.createDataFrame(
        [("g", "00"), ("AB", "00"), ("ab", "00"), ("zz", "x")], "method_change_id string, file_change_id string").withColumns(
        {"name": F.lit("f"), "signature": F.lit(None).cast("string"), "parameters": F.lit("a"), "start_line": F.lit(1), "end_line": F.lit(2)})
    assert rows(P.one_method_per_key(methods), "method_change_id", "file_change_id") == [("AB", "00"), ("zz", "x")]


@pytest.mark.parametrize("side", [None, "side"])
def test_methods_of_one_bin_are_not_shuffled_again(spark, rows, plan, side):  # F22, F23
    lines = spark.createDataFrame([("f", "a", 5), ("f", "a", 5), ("f", "a", 150), ("f", None, 7), ("f", "b", 99), ("g", "a", 5)], "f string, side string, line int")
    methods = spark.createDataFrame(
        [("f", "a", 1, 10, "m1"), ("f", "a", 1, 10, "m1"), ("f", "a", 90, 160, "m2"), ("f", None, 7, 7, "m3"), ("f", "b", 1, 98, "m4"), ("h", "a", 1, 9, "m5")],
        "f string, side string, start_line int, end_line int, name string")
    got = CH.changed_methods(lines, methods, "f", side)
    wanted = [m for m in sorted({tuple(r) for r in methods.collect()}, key=repr) if any(
        f == m[0] and (side is None or s == m[1]) and m[2] <= n <= m[3] for f, s, n in map(tuple, lines.collect()))]
    assert rows(got) == wanted
    lines_of = plan(got)
    union = next(i for i, line in enumerate(lines_of) if line.startswith("Union"))
    first = next(i for i, line in enumerate(lines_of) if "Join" in line)
    assert not exchanges(lines_of[union:first])


def test_sets_with_one_rare_token_are_no_candidates(spark, rows):  # F7
    sets = [(i, ["rare", *sorted(f"t{i}_{k}" for k in range(9))], 1, 1) for i in range(30)] + [
        (100, ["rare", *sorted(f"t0_{k}" for k in range(9)), "x"], 0, 1)]
    df = spark.createDataFrame(sets, "_set long, tokens array<string>, n_queries int, n_docs int")
    found = set(rows(TW.close_sets(df, 0.8)))
    assert found >= {(i, i) for i in range(30)} | {(0, 100)} and len(found) < 40


def test_similar_texts_of_both_sides_stand_once(spark, rows):  # F7
    asked = spark.createDataFrame([(7, "a b c d e"), (5, "e d c b a"), (9, "z"), (1, ""), (2, None)], "query_id int, text string")
    stored = spark.createDataFrame([(30, "a b c d e"), (20, "a b c d"), (40, "y")], "doc_id int, text string")
    assert rows(TW.similar_texts(asked, stored)) == [(5, 2, 20, 1, 0.8), (5, 2, 30, 1, 1.0)]


def test_band_rows_of_scopes_hold_twins_only(spark, rows):  # F4
    of_repository = spark.createDataFrame(
        [("r", c, k) for c, ks in {"a": "k1 k2 k3", "b": "k1 k2 k4", "c": "k5 k6", "d": "k6 k7"}.items() for k in ks.split()]
        + [("q", "a", "k1")], "repo string, id string, band_key string")
    members = spark.createDataFrame([("c1", "r", x) for x in "abcd"] + [("c2", "r", x) for x in "acd"] + [("c3", "r", "a"), ("c3", "q", "a")],
                                    "cve string, repo string, id string")
    bands = TW.bands_of_scopes(members, of_repository, ["cve", "repo"], ["repo"], "id")
    # k1 and k2 have the same members; a alone of its twins stands under c2, and c3 has no twins at all
    assert rows(bands, "cve", "repo", "id") == [
        ("c1", "r", "a"), ("c1", "r", "b"), ("c1", "r", "c"), ("c1", "r", "d"), ("c2", "r", "c"), ("c2", "r", "d")]
    assert bands.schema["band_key"].dataType.simpleString() == "bigint"
    whole = members.join(of_repository, ["repo", "id"])
    ranked = members.withColumn("rank", F.ascii("id"))
    for found in (lambda b: TW.remove_twins(ranked, b, ["cve", "repo"], "id", "rank"), lambda b: TW.with_twins(b, ["cve", "repo"], "id"),
                  lambda b: TW.twins_of_kept(ranked.filter("id IN ('a', 'c')"), b, ["cve", "repo"], "id")):
        assert rows(found(bands).select("cve", "repo", "id")) == rows(found(whole).select("cve", "repo", "id"))


def test_ranking_job_takes_no_band_rows_without_twins(spark, monkeypatch):  # F4
    from vulnlake.plans import jobs

    taken = []
    whole = TW.remove_twins
    monkeypatch.setattr(TW, "remove_twins", lambda ranked, bands, *rest: taken.append(bands.count()) or whole(ranked, bands, *rest))
    commits = spark.createDataFrame([(f"{i}" * 40, "r", f"{w} " * 3) for i, w in enumerate(["alpha", "alpha", "beta", "gamma"])], "commit_id string, repo_url string, message string").select(
        "*", F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"), F.array(F.lit("a.c")).alias("changed_files"), F.array(F.lit("+x")).alias("diff"))
    words = F.array(F.lit("alpha"))
    advisories = spark.createDataFrame([("c", "r")], "cve_id string, repo_url string").select(
        "*", F.timestamp_seconds(F.lit(1_700_000_000)).alias("reserved"), words.alias("keywords"), words.alias("files"),
        F.array().cast("array<string>").alias("extensions"), F.create_map(F.lit("x"), F.lit(1)).alias("references"))
    none = spark.createDataFrame([], "repository string, issue_id string, content string")
    weights = spark.createDataFrame([], "cve_id string, ref string, weight int")
    kept, _ = jobs.rank_candidates(advisories, commits, weights, none, none)
    assert {r.commit_id[0] for r in kept.collect()} & {"2", "3"} == {"2", "3"} and kept.count() == 3
    assert taken == [2]
