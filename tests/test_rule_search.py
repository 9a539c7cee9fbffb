"""Terms of many advisories searched in the texts of commits."""

import random

from pyspark.sql import functions as F

from vulnlake.functions.search import Terms, contained
from vulnlake.operators import rules as RU


def test_contained_is_what_contains_finds(spark):  # F18, F19, F20, F28, F29
    random.seed(3)
    letters = "ab c\né€"
    word = lambda n: "".join(random.choice(letters) for _ in range(random.randint(0, n)))
    data = [([word(7) for _ in range(12)] + [None], word(60)) for _ in range(200)]
    data += [(["x"], None), (None, "x"), ([], "x"), (["aaaa", "aaab", "aaaa"], "aaaaab"), (["", "abcde"], "abcd")]
    df = spark.createDataFrame(data, "terms array<string>, text string")
    plain = F.transform(F.array("text"), lambda t: F.filter("terms", lambda k: F.contains(t, k)))[0]
    assert df.filter(~contained("terms", "text").eqNullSafe(plain)).count() == 0


def test_a_text_is_gone_over_once_for_all_terms():  # F28
    class Text(bytes):
        searches = 0

        def __contains__(self, term):
            Text.searches += 1
            return bytes.__contains__(self, term)

    terms = [b"term%05d" % i for i in range(1000)]
    assert Terms(terms).within(Text(b"no such word but term00007")) == {b"term00007"}
    assert Text.searches == 0


def test_pairs_carry_what_the_rules_look_at_to_a_fixed_number_of_tasks(spark):  # F25
    pairs = spark.createDataFrame([("c", "r", f"{i}") for i in range(40)], "cve_id string, repository string, commit_id string")
    words = F.array(F.lit("alpha"))
    advisories = spark.createDataFrame([("c", "r")], "cve_id string, repository string").select(
        "*", words.alias("keywords"), words.alias("files"), F.create_map(F.lit("x"), F.lit(1)).alias("references"))
    none = spark.createDataFrame([], "repository string, issue_id string, content string")
    commits = pairs.select("commit_id", "repository", F.lit("alpha").alias("message"), F.array(F.lit("alpha.c")).alias("changed_files"), F.array(F.lit("+x")).alias("diff"))
    found = RU.score_pairs(pairs, RU.commit_features(commits, none, none), advisories, ["ADV_KEYWORDS_IN_FILES"])
    assert found.filter("relevance = 4").count() == 40
    plan = found._jdf.queryExecution().toString()
    analyzed = plan.split("== Analyzed Logical Plan ==")[1].split("== Optimized Logical Plan ==")[0]
    assert "collect_list(struct(cve_id" in analyzed and not [x for x in analyzed.split("\n") if "collect_list(struct(" in x and "references" in x]
    assert "REPARTITION_BY_NUM" in plan.split("== Physical Plan ==")[1]
