"""Repository tags of a version interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vulnlake.functions import versions as V
from vulnlake.operators.keyed import top_k_per_key

SIMILAR_TAG = 0.8
CLOSE_MATCH = 0.6


def tags_of_intervals(tags: DataFrame, intervals: DataFrame) -> DataFrame:
    """Tag pair per version interval ``(id, prev_tag, next_tag)``.

    ``tags``: ``(repo_url, pos, tag)`` in commit order; ``intervals``: ``(id, repo_url, interval)`` with ``a:b``.
    How well every tag fits either end is a set of flags; counts and first or last hits of the flags decide, and
    they combine on the map side, so a repository's tags are never gathered.
    """
    ends = F.split(F.replace("interval", F.lit("None"), F.lit("")), ":")
    asked = intervals.select("id", "repo_url", ends[0].alias("low"), ends[1].alias("high"))
    rows = asked.join(tags, "repo_url")
    tag = F.col("tag")
    aggregates: list[Column] = []
    for end in ("low", "high"):
        v = F.col(end)
        close = (
            F.endswith(tag, v) | (F.contains(tag, v) & V.ends_with_zero(tag)) | (F.contains(v, tag) & V.ends_with_zero(v))
        )
        same_number = (v != "") & (V.digits_of_tag(tag) == v) & ~V.is_rc_or_date(tag)
        loose = F.contains(V.dotted_tag(tag), v)
        for flag, hit in (("exact", tag == v), ("close", close), ("number", same_number), ("loose", loose)):
            aggregates += [
                F.count_if(hit).alias(f"{end}_{flag}_n"),
                F.min_by(tag, F.when(hit, F.col("pos"))).alias(f"{end}_{flag}_first"),
            ]
    fits = rows.groupBy("id", "repo_url", "low", "high").agg(*aggregates)
    for end in ("low", "high"):
        exact, close = F.col(f"{end}_exact_n") > 0, F.col(f"{end}_close_n") == 1
        fits = fits.withColumn(f"{end}_n", F.when(exact | close, 1).otherwise(F.col(f"{end}_number_n"))).withColumn(
            f"{end}_tag",
            F.when(exact, F.col(end)).when(close, F.col(f"{end}_close_first")).otherwise(F.col(f"{end}_number_first")),
        )
    # ends that several tags fit, and neighbours of an end that stands alone, need the other end's tag
    anchors = fits.select("id", "repo_url", "low", "high", "low_n", "high_n", "low_tag", "high_tag")
    again = anchors.join(tags, "repo_url")
    known = F.coalesce(F.when(F.col("low_n") == 1, F.col("low_tag")), F.when(F.col("high_n") == 1, F.col("high_tag")))

    def number_hit(end: str) -> Column:
        return (F.col(end) != "") & (V.digits_of_tag(tag) == F.col(end)) & ~V.is_rc_or_date(tag)

    is_known = tag == F.col("_known")
    again = again.withColumn("_known", known).withColumn("_alike", V.sequence_ratio(tag, F.coalesce("_known", tag)) > SIMILAR_TAG)
    second = again.groupBy("id", "repo_url").agg(
        F.min_by(tag, F.when(number_hit("high") & (tag != F.col("low_tag")), F.col("pos"))).alias("_next"),
        F.max_by(tag, F.when(number_hit("low") & (tag != F.col("high_tag")), F.col("pos"))).alias("_prev"),
        F.max(F.when(F.col("_alike"), F.col("pos"))).alias("_last_alike"),
        F.min(F.when(F.col("_alike"), F.col("pos"))).alias("_first_alike"),
        F.min(F.when(is_known, F.col("pos"))).alias("_at"),
    )
    n = (F.least("low_n", F.lit(2)) * 10 + F.least("high_n", F.lit(2))).alias("n")
    empty_low, empty_high = F.col("low") == "", F.col("high") == ""
    alone_before = F.coalesce(F.col("_first_alike") >= F.col("_at"), F.lit(True))
    alone_after = F.coalesce(F.col("_last_alike") <= F.col("_at"), F.lit(True))
    low_loose, high_loose = F.col("low_loose_n"), F.col("high_loose_n")
    nothing = F.lit(None).cast("string")
    prev = (
        F.when(n.isin(11, 12), F.col("low_tag"))
        .when(n == 21, F.coalesce("_prev", "low_tag"))
        .when(n == 1, F.when(empty_low & alone_before, ""))
        .when(n == 10, F.when(empty_high & alone_after, F.col("low_tag")))
        .when((n == 0) & (low_loose == 1) & ((high_loose == 1) | ((high_loose == 0) & empty_high)), F.col("low_loose_first"))
        .otherwise(nothing)
    )
    nxt = (
        F.when(n.isin(11, 21), F.col("high_tag"))
        .when(n == 12, F.coalesce("_next", "high_tag"))
        .when(n == 1, F.when(empty_low & alone_before, F.col("high_tag")))
        .when(n == 10, F.when(empty_high & alone_after, ""))
        .when((n == 0) & (high_loose == 1) & ((low_loose == 1) | ((low_loose == 0) & empty_low)), F.col("high_loose_first"))
        .otherwise(nothing)
    )
    return fits.join(second, ["id", "repo_url"]).select("id", prev.alias("prev_tag"), nxt.alias("next_tag"))


def closest_tag(tags: DataFrame, versions: DataFrame) -> DataFrame:
    """Tag whose digits look most like the version's ``(id, tag, ratio)``; the earlier tag wins a tie."""
    rows = versions.join(tags, "repo_url").withColumn(
        "ratio", V.sequence_ratio(V.only_digits(F.col("tag")), V.only_digits(F.col("version")))
    )
    best = F.max(F.struct(F.col("ratio"), (-F.col("pos")).alias("early"), F.col("tag"))).alias("b")
    return rows.filter(F.col("ratio") > 0).groupBy("id").agg(best).select("id", F.col("b.tag").alias("tag"), F.col("b.ratio").alias("ratio"))


def close_tags(tags: DataFrame, versions: DataFrame, before: bool, most: int | None = None) -> DataFrame:
    """Tags whose version text resembles the asked one, on one side of the other end, the best ``most`` or all.

    ``tags``: ``(repo_url, version_key, tag)``; ``versions``: ``(id, repo_url, version, other)``.
    """
    keys = tags.select("repo_url", "version_key").distinct()
    scored = (
        versions.join(keys, "repo_url")
        .withColumn("ratio", V.sequence_ratio(F.col("version_key"), F.col("version")))
        .filter(F.col("ratio") >= CLOSE_MATCH)
    )
    side = F.col("version_key") < F.col("other") if before else F.col("version_key") > F.col("other")
    order = [F.desc("ratio"), F.desc("version_key")]
    if most is None:
        best = scored.filter(side).withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order)))
    else:
        best = top_k_per_key(scored.filter(side), ["id"], order, most)
    return best.join(tags, ["repo_url", "version_key"]).select("id", "rank", "tag")
