"""Quality rules: robust multivariate outliers per language and source, in DataFrame operations only.

Every document has a vector of transformed statistics of its text.  Per (language, source) a minimum covariance
determinant estimate gives the centre and spread of the documents that agree best: start from the middle of each
statistic, then repeat concentration steps, each of which takes the mean and covariance of the share of documents
with the smallest Mahalanobis distances.  A document whose squared distance lies beyond the limit is rejected.

Each step is one aggregation of sums per group and one histogram of distances per group, so a group with a third
of all rows is summed on the map side and never gathered.  Statistics are fixed-point numbers and their sums
exact, so results do not depend on the order of rows.  Groups with too few documents for a covariance use the
estimate of their language, then that of all documents.  The spread of each statistic has a floor, so that a
group of equal documents does not reject every other one.

Beside it stand the base figures and rules, in the contract of :func:`judge`.  Null and empty texts have no words
and fail the base rules; null languages or sources are groups of their own; repeated rows are judged alike; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import cut_lineage

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
SCALE = 1000
STATISTICS = ("s_length", "s_word", "s_symbols", "s_lines", "s_repeats")
#: Smallest standard deviation that a statistic is taken to have, in its own unit.
FLOORS = (0.6, 0.12, 0.05, 0.15, 0.25)
CORE = 0.75  # share of a group's documents that an estimate rests on
STEPS = 3
LIMIT = 40.0  # squared distance, beyond the 0.9999998 point of chi-square with five degrees
LEAST_GROUP = 50
ROWS_PER_TASK = 100_000
BINS = 32  # bins of the histogram of distances per doubling


def _repeated_words(words: Column) -> Column:
    """Words in windows of three that stand twice or more in the text, the first included.

    The windows are sorted by hash and place; a window equal to a neighbour in that order is repeated, and each
    of its three words counts once.
    """
    n = F.size(words)
    windows = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )

    def covered(sorted_windows: Column) -> Column:
        again = F.filter(
            sorted_windows,
            lambda w, k: (F.get(sorted_windows, k + 1)["h"].eqNullSafe(w["h"])) | ((k > 0) & F.get(sorted_windows, F.greatest(k - 1, F.lit(0)))["h"].eqNullSafe(w["h"])),
        )
        places = F.sort_array(F.transform(again, lambda w: w["i"]))
        # a window adds as many words as lie beyond the one before it, three at most
        return F.aggregate(
            places, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"],
        )

    return F.when(n < 4, F.lit(0)).otherwise(
        F.element_at(F.transform(F.array(F.sort_array(windows)), covered), 1)
    )


def figures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base figures of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, SPACES), "")
    rows = docs.select("doc_id", "lang", "source", text.alias("_text"), words.alias("_words"))
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashes = F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))
    some_repeat = (F.size("_words") >= 4) & (F.size(F.array_distinct(hashes)) < F.size("_words") - 2)
    return rows.select(
        "doc_id", "lang", "source", F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(some_repeat, _repeated_words(F.col("_words"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _statistics(rows: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    values = (
        F.log1p(F.col("n_words")), F.log1p(F.col("word_chars") / n), F.sqrt(F.col("n_symbols") / F.greatest("word_chars", F.lit(1))),
        F.sqrt(F.col("n_dup_lines") / F.greatest("_lines", F.lit(1))), F.sqrt(F.col("n_repeat_words") / n),
    )
    return rows.withColumns({name: F.round(v * SCALE).cast("long") for name, v in zip(STATISTICS, values, strict=True)})


def _distance(d: int) -> Column:
    """Squared distance from the columns of an estimate: centres c<i> and the rows l<i>_<j> of its Cholesky factor."""
    solved: list[Column] = []
    for i in range(d):
        x = F.col(STATISTICS[i]) / SCALE - F.col(f"c{i}")
        for j in range(i):
            x = x - F.col(f"l{i}_{j}") * F.col(f"_z{j}")
        solved.append(x / F.col(f"l{i}_{i}"))
    return solved


def _with_distance(rows: DataFrame) -> DataFrame:
    for i, z in enumerate(_distance(len(STATISTICS))):
        rows = rows.withColumn(f"_z{i}", z)
    total = F.col("_z0") * F.col("_z0")
    for i in range(1, len(STATISTICS)):
        total = total + F.col(f"_z{i}") * F.col(f"_z{i}")
    return rows.withColumn("d2", total).drop(*[f"_z{i}" for i in range(len(STATISTICS))])


def _estimate(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and Cholesky factor of the covariance per group, from exact sums; spreads have their floors."""
    d = len(STATISTICS)
    sums = [F.count(F.lit(1)).alias("n_core")] + [F.sum(s).alias(f"t{i}") for i, s in enumerate(STATISTICS)]
    sums += [F.sum((F.col(STATISTICS[i]) * F.col(STATISTICS[j])).cast("decimal(20,0)")).alias(f"q{i}_{j}") for i in range(d) for j in range(i + 1)]
    out = rows.groupBy(*keys).agg(*sums)
    out = out.select(*keys, "n_core", *[(F.col(f"t{i}") / F.col("n_core") / SCALE).alias(f"c{i}") for i in range(d)], *[
        (F.col(f"q{i}_{j}").cast("double") / F.col("n_core") / SCALE**2).alias(f"m{i}_{j}") for i in range(d) for j in range(i + 1)
    ])
    cov = {(i, j): F.col(f"m{i}_{j}") - F.col(f"c{i}") * F.col(f"c{j}") for i in range(d) for j in range(i + 1)}
    out = out.withColumns({f"v{i}_{j}": cov[i, j] + (FLOORS[i] ** 2 if i == j else 0.0) for i in range(d) for j in range(i + 1)})
    for j in range(d):
        for i in range(j, d):
            x = F.col(f"v{i}_{j}")
            for k in range(j):
                x = x - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            out = out.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(x, F.lit(1e-9))) if i == j else x / F.col(f"l{j}_{j}"))
    return out.select(*keys, "n_core", *[f"c{i}" for i in range(d)], *[f"l{i}_{j}" for j in range(d) for i in range(j, d)])


def _same(keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return out


def _beside(rows: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row with its group's columns; the one row of a table without keys becomes literals."""
    if not keys:
        only = groups.first()
        return rows.withColumns({c: F.lit(only[c]).cast(t) for c, t in groups.dtypes} if only else {c: F.lit(None).cast(t) for c, t in groups.dtypes})
    named = groups.withColumnsRenamed({k: f"_{k}" for k in keys})
    return rows.join(named, _same(keys)).drop(*[f"_{k}" for k in keys])


def _core(rows: DataFrame, keys: Sequence[str], score: Column) -> DataFrame:
    """The documents of the bins that hold the smallest ``CORE`` share of each group's scores."""
    from pyspark.sql.window import Window

    at = F.floor(F.log2(F.greatest(score, F.lit(1e-6))) * BINS).cast("int").alias("_bin")
    binned = rows.withColumn("_bin", at)
    counts = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    upto = counts.withColumn("_to", F.sum("_n").over(whole.orderBy("_bin"))).withColumn("_all", F.sum("_n").over(whole))
    last = upto.filter(F.col("_to") >= F.col("_all") * CORE).groupBy(*keys).agg(F.min("_bin").alias("_last"))
    return _beside(binned, last, keys).filter("_bin <= _last").drop("_bin", "_last")


def estimates(stats: DataFrame, keys: Sequence[str], steps: int = STEPS) -> DataFrame:
    """Minimum covariance determinant estimates per group by concentration steps."""
    middles = stats.groupBy(*keys).agg(*[F.percentile_approx(s, 0.5, 10000).alias(f"_m{i}") for i, s in enumerate(STATISTICS)])
    middles = cut_lineage(middles)
    start = F.lit(0.0)
    for i, s in enumerate(STATISTICS):
        start = start + F.pow((F.col(s) - F.col(f"_m{i}")) / (SCALE * FLOORS[i]), F.lit(2.0))
    core = _core(_beside(stats, middles, keys), keys, start)
    found = cut_lineage(_estimate(core, keys))
    for _ in range(steps):
        found = cut_lineage(_estimate(_core(_with_distance(_beside(stats, found, keys)), keys, F.col("d2")), keys))
    return found


def judge(docs: DataFrame, limit: float = LIMIT, least_group: int = LEAST_GROUP, steps: int = STEPS) -> DataFrame:
    """Base figures, base_failed, the squared robust distance and the verdict of every document.

    Base figures: n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word, equal to
    an earlier line) and n_repeat_words.  base_failed: fewer than 50 words, or more than half of the words
    repeated.  kept: passes the base rules and lies within the limit of its group.  Estimates rest on documents
    that pass the base rules.
    """
    stats = cut_lineage(_statistics(figures(docs)).withColumn(
        "base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    ))
    # the rows are narrow now: the passes over them need fewer tasks than the texts did
    stats = stats.coalesce(max(1, -(-stats.count() // ROWS_PER_TASK)))
    sound = stats.filter("NOT base_failed").select("lang", "source", *STATISTICS)
    levels = [["lang", "source"], ["lang"], []]
    sizes = "n_core"
    chosen = None
    for keys in levels:
        own = estimates(sound, keys, steps).filter(F.col(sizes) >= (least_group * CORE if keys else 0))
        packed = own.select(*keys, F.struct(*[c for c in own.columns if c not in keys]).alias(f"_e{len(keys)}"))
        base = stats if chosen is None else chosen
        if keys:
            named = packed.withColumnsRenamed({k: f"_{k}" for k in keys})
            chosen = base.join(named, _same(keys), "left").drop(*[f"_{k}" for k in keys])
        else:
            kinds = [(f.name, f.dataType) for f in packed.schema["_e0"].dataType.fields]
            only = packed.first()
            chosen = base.withColumn("_e0", F.struct(*[F.lit(only["_e0"][n] if only else None).cast(t).alias(n) for n, t in kinds]))
    rows = chosen.withColumn("_e", F.coalesce("_e2", "_e1", "_e0")).select("*", "_e.*")
    rows = _with_distance(rows)
    kept = ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= limit)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.col("d2").alias("distance"),
    )
