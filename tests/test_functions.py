from pyspark.sql import functions as F

from vulnlake.functions import diffs as D
from vulnlake.functions import similarity as SIM
from vulnlake.functions import text as X
from vulnlake.functions import times as TI
from vulnlake.functions import urls as U
from vulnlake.functions import versions as V


def one(spark, expr, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expr.alias("x")).first().x


def test_urls(spark):
    u = F.col("u")
    assert one(spark, U.clean_git_url(u), u="git+https://git@github.com/a/b.git") == "https://github.com/a/b"
    assert one(spark, U.base_repo_url(u), u="http://GitHub.com/a/b/c?x=1") == "https://github.com/a/b"
    assert one(spark, U.package_name(u), u="https://pkg.go.dev/github.com/x/y@latest?tab=doc") == "github.com/x/y"
    assert one(spark, U.package_name(u), u="https://pkg.go.dev/vuln/GO-2020-1") is None
    assert one(spark, U.is_blacklisted(u), u="https://github.com/a/IoT") is True
    assert one(spark, U.commit_reference(u), u="https://g.org/?p=x;a=commit;h=abcdef1") == "commit::abcdef1"


def test_affected_names(spark):
    t = F.col("t")
    text = "org/mitre/oauth2/web/OAuthConfirmationController.java and Content-Length via JwtRequestCodeFilter in Node.js 1.2.3"
    assert one(spark, X.affected_files(t), t=text) == ["Content-Length", "JwtRequestCodeFilter", "OAuthConfirmationController"]
    assert one(spark, X.affected_extensions(t), t=text) == ["java"]


def test_keywords_need_whole_tokens(spark):
    t = F.col("t")
    assert one(spark, X.security_keywords(t), t="Fix XSS in sql injection") == ["injection", "xss"]


def test_path_similarity_measures(spark):
    pairs = spark.createDataFrame([("g", "Unalaq/Aang/Suyin Beifong", "Sokka_Unalaq"), ("g", "a/b", "b/a")], "g string, p string, t string")
    got = {r.t: r for r in SIM.path_similarities(pairs, "g", "p", "t").collect()}
    assert round(got["Sokka_Unalaq"].jaccard, 6) == 0.2
    assert (got["Sokka_Unalaq"].levenshtein, got["Sokka_Unalaq"].damerau_levenshtein) == (4, 4)
    assert (got["b/a"].levenshtein, got["b/a"].damerau_levenshtein) == (2, 1)
    assert got["b/a"].inverted_levenshtein == 0.5


def test_hunks_and_diff_lines(spark, rows):
    diff = "@@ -1,2 +1,3 @@\n a\n-b\n+c\n+d\n@@ -10,1 +11,1 @@\n-x\n e\n+y\n"
    df = spark.createDataFrame([("f", diff)], "f string, diff string")
    assert df.select(D.hunk_count(F.split("diff", "\n")).alias("n")).first().n == 3
    assert rows(D.diff_lines(df, "f", "diff"), "side", "line", "text") == sorted(
        [("deleted", 2, "b"), ("added", 2, "c"), ("added", 3, "d"), ("deleted", 10, "x"), ("added", 12, "y")], key=repr)


def test_versions(spark):
    affected, fixed = V.affected_and_fixed(F.col("t"))
    text = "App versions 1.2 through 1.4.1 are hit. Fixed before 1.5.0 was out"
    assert (one(spark, affected, t=text), one(spark, fixed, t=text)) == ("1.4.1", "1.5.0")
    assert one(spark, V.ends_with_zero(F.col("t")), t="v1.0") is True


def test_runtime_parts_add_up(spark):
    df = spark.createDataFrame([(0,), (59,), (3600,), (86399,), (123456789,)], "s long")
    h, m, s = TI.runtime_parts(F.col("s"))
    for r in df.select("s", h.alias("h"), m.alias("m"), s.alias("x")).collect():
        assert r.h * 3600 + r.m * 60 + r.x == r.s and 0 <= r.m < 60 and 0 <= r.x < 60


def test_method_code(spark):
    code = X.line_range(F.col("c"), F.lit(2), F.lit(3))
    assert one(spark, code, c="a\nb\nc\nd") == "b\nc"
    assert one(spark, X.line_range(F.lit(None).cast("string"), F.lit(1), F.lit(2)), c="") is None
