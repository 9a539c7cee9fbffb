"""Mixing sources to target weights by Pareto order sampling.

A source of target t and size s (t <= 2 s) takes floor(t / s) whole copies of each of its documents for
certain.  The words still missing come from one sample without replacement: documents are ranked by their
random odds divided by their inclusion odds, and the front of that order is taken up to the missing size,
so the sample's size is fixed while longer documents are somewhat likelier (odds grow with the square root
of their size).  The order of a hot source is cut by two rounds of histograms, so only the few documents
around the cut are ever sorted.

Null texts have size 0; null sources form one source, last in order; rows that tie in random number and
document id (repeated rows) are taken or left together; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vulnlake.llm.common import cut_lineage, n_words, whole_row

BINS = 4096


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Rows (source, source_size, n_docs, target): shares by weight, none above ``most`` times its source.

    Works on one row per source.  Filled like water: sources whose limit is reached first, by limit per weight,
    are full; what is left goes to the others by weight.
    """
    totals = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("n_docs")
    )
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(in_order) - 1, len(weights)) + 1
    )
    limit = F.col("source_size") * float(most)
    rows = totals.select("*", F.row_number().over(in_order).alias("_at"), weight.alias("_w"), limit.alias("_limit"))
    filled = Window.orderBy(F.col("_limit") / F.col("_w"), "_at")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    open_weight = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    rows = rows.withColumn("_level", left / open_weight)
    rows = rows.withColumn("_full", F.col("_limit") < F.col("_w") * F.col("_level"))
    rows = rows.withColumn("_at_fill", F.row_number().over(filled))
    level = F.min(F.when(~F.col("_full"), F.struct("_at_fill", "_level"))).over(everything)["_level"]
    return rows.select(
        "source", "source_size", "n_docs",
        F.when(F.col("_full"), F.col("_limit")).otherwise(F.least("_limit", F.col("_w") * level)).alias("target"),
    )


def _ranked(rows: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Adds the source's figures, whole copies and the Pareto rank value (null where nothing is drawn)."""
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    rows = rows.withColumn("_whole", F.floor(ratio)).withColumn("_part", ratio - F.floor(ratio))
    drawn = (F.col("_part") > 0) & (F.col("size") > 0)
    digits = F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(str(seed)))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)
    odds = F.col("_part") / (1 - F.col("_part")) * F.sqrt(F.col("size") * F.col("n_docs") / F.col("source_size"))
    rows = rows.withColumn("_u", F.when(drawn, u)).withColumn("_q", F.col("_u") / (1 - F.col("_u")) / odds)
    return rows.withColumn("rank_value", F.col("_q") / (1 + F.col("_q"))).drop("_u", "_q")


def _cut(level: DataFrame, by: Sequence[str], need: DataFrame) -> DataFrame:
    """Per source, the first value of ``by`` at which the running size reaches the need, and the need left in it."""
    sums = level.groupBy("source", *by).agg(F.sum("size").alias("_sum"))
    sums = sums.withColumn("_to", F.sum("_sum").over(Window.partitionBy("source").orderBy(*by)))
    sums = sums.join(need, F.col("source").eqNullSafe(F.col("_s")))
    reached = (F.col("_to") >= F.col("_need")) & (F.col("_to") - F.col("_sum") < F.col("_need"))
    return sums.filter(reached).select(F.col("source").alias("_s"), *by, (F.col("_need") - F.col("_to") + F.col("_sum")).alias("_need"), "_sum")


def _within(rows: DataFrame, cut: DataFrame, by: str) -> DataFrame:
    at = cut.select(F.col("_s").alias("_t"), F.col(by).alias("_at"))
    return rows.join(at, F.col("source").eqNullSafe(F.col("_t")) & (F.col(by) == F.col("_at"))).drop("_t", "_at")


def mix(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17,
) -> DataFrame:
    """How many words of each document the mix takes.

    Returns doc (the whole input row), doc_id, source, size, source_size, target, copies (whole copies taken),
    taken (copies * size) and rank_value.  A document is taken at most ``ceil(most)`` times.  Only narrow rows
    are kept or shuffled; texts stay where they were read.
    """
    size = n_words(F.col("text")).alias("size")
    sizes = cut_lineage(docs.select("doc_id", "source", size))
    targets = cut_lineage(source_targets(sizes, weights, share, most))
    ranked = _ranked(sizes, targets, seed).filter(F.col("rank_value").isNotNull())
    ranked = ranked.withColumn("_bin", F.floor(F.col("rank_value") * BINS))
    ranked = ranked.withColumn("_fine", F.floor((F.col("rank_value") * BINS - F.col("_bin")) * BINS))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    need = targets.select(F.col("source").alias("_s"), (F.col("target") - F.col("source_size") * F.floor(ratio)).alias("_need"))
    coarse = cut_lineage(_cut(ranked, ["_bin"], need))
    near = _within(ranked, coarse, "_bin")
    fine = cut_lineage(_cut(near, ["_fine"], coarse.select("_s", "_need")))
    last = _cut(_within(near, fine, "_fine"), ["rank_value", "doc_id"], fine.select("_s", "_need"))
    # the document at the cut is taken where that comes nearer to the target
    bounds = cut_lineage(last.select(
        F.col("_s").alias("_t"), F.col("rank_value").alias("_r"), F.col("doc_id").alias("_d"), (F.col("_need") * 2 >= F.col("_sum")).alias("_with")
    ))
    rows = _ranked(docs.select(whole_row(docs).alias("doc"), "doc_id", "source", size), targets, seed)
    rows = rows.join(bounds, F.col("source").eqNullSafe(F.col("_t")), "left")
    same = F.col("rank_value") == F.col("_r")
    at_cut = same & F.col("doc_id").eqNullSafe(F.col("_d"))
    ahead = (F.col("rank_value") < F.col("_r")) | (same & F.coalesce(F.col("doc_id") < F.col("_d"), F.col("doc_id").isNull() & F.col("_d").isNotNull()))
    copies = F.col("_whole") + F.coalesce((ahead | (at_cut & F.col("_with"))).cast("long"), F.lit(0).cast("long"))
    return rows.select(
        "doc", "doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"), "rank_value",
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of the input."""
    copies = mix(docs, **options).filter("copies > 0")
    return copies.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def sql(weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> str:
    """The same mix in DuckDB over ``documents``, with one plain running sum per source."""
    listed = ", ".join(str(float(w)) for w in weights)
    return rf"""WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) FILTER (size > 0) AS n_docs,
    row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM sizes GROUP BY source),
weighted AS (SELECT *, [{listed}][(nth - 1) % {len(weights)} + 1]::DOUBLE AS w, source_size * {float(most)}::DOUBLE AS lim FROM totals),
filling AS (
  SELECT *, row_number() OVER fill AS at_fill,
    (sum(source_size) OVER () * {float(share)}::DOUBLE - coalesce(sum(lim) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w::DOUBLE) OVER () - coalesce(sum(w::DOUBLE) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighted WINDOW fill AS (ORDER BY lim / w, nth)),
level AS (SELECT arg_min(level, at_fill) AS final FROM filling WHERE NOT lim < w * level),
targets AS (
  SELECT source, source_size, n_docs, CASE WHEN lim < w * level THEN lim ELSE least(lim, w * final) END AS target
  FROM filling, level),
odds AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, t.n_docs,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS ratio,
    (('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, '-') || ':{seed}'), 1, 13))::BIGINT::DOUBLE + 0.5) / {1 << 52}::DOUBLE AS u
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
ranked AS (
  SELECT *, floor(ratio) AS whole, target - source_size * floor(ratio) AS need,
    CASE WHEN ratio - floor(ratio) > 0 AND size > 0 THEN u / (1 - u) /
      ((ratio - floor(ratio)) / (1 - (ratio - floor(ratio))) * sqrt(size * n_docs / source_size)) END AS q
  FROM odds),
running AS (
  SELECT *, q / (1 + q) AS v, CASE WHEN q IS NOT NULL THEN
      sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q / (1 + q) NULLS LAST, doc_id NULLS FIRST) END AS upto,
    sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source, q / (1 + q), doc_id) AS own FROM ranked)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN q IS NULL THEN 0 WHEN upto < need THEN 1
    WHEN upto - own < need AND (need - (upto - own)) * 2 >= own THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running"""
