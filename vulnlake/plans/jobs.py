"""Whole jobs: from landed feeds to tables, from tables to ranked fix commits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnlake import constants as K
from vulnlake import schema as S
from vulnlake.functions import urls as U
from vulnlake.functions.diffs import diff_lines
from vulnlake.operators import candidates as C
from vulnlake.operators import links as L
from vulnlake.operators import ranking as R
from vulnlake.operators import rules as RU
from vulnlake.operators import twins as TW
from vulnlake.operators.changes import file_rows, method_rows
from vulnlake.operators.keyed import first_per_key, top_k_per_key
from vulnlake.operators.products import ProductPairs
from vulnlake.operators.store import Store, Transaction
from vulnlake.operators.tables import conform, insert_ignore, stringify
from vulnlake.session import cut_lineage
from vulnlake.sources import feeds


def map_cpe_to_cve(projects: DataFrame, mapping: DataFrame) -> DataFrame:
    """Project links of the CVEs that name a product with a known repository, once per pair."""
    return ProductPairs(projects, mapping).rows().select(
        "cve", "project_url", F.concat(F.lit("CPE_"), F.col("rel_type")).alias("rel_type"),
        F.lit(K.PAIR_NOT_STARTED).alias("checked"))


def apply_cpe_mappings(store: Store) -> DataFrame:
    """Fill ``cve_project`` from ``cpe_project`` by the products that the records in ``cve`` name; one transaction.

    The products of each CVE become the table ``cve_cpe_mapper``.  A (CVE, project) that is there already keeps its row.
    Returns the products with a project that no CVE names, with the number of their projects.
    """
    def change(work: Transaction) -> None:
        mapping = feeds.cpe_names(work.read("cve"))
        projects = conform(map_cpe_to_cve(work.read("cpe_project"), mapping), S.CVE_PROJECT, S.CVE_PROJECT_DEFAULTS)
        work.replace("cve_cpe_mapper", mapping)
        if work.exists("cve_project"):
            projects = insert_ignore(work.read("cve_project"), projects, S.CVE_PROJECT_KEY, [F.col("rel_type")])
        work.replace("cve_project", projects)

    store.retry(change)
    return store.read("cpe_project").join(store.read("cve_cpe_mapper"), "cpe_name", "left_anti").groupBy("cpe_name").agg(
        F.count(F.lit(1)).alias("projects"))


def is_pending(min_score: int = K.MIN_FIX_SCORE) -> Column:
    return (F.col("score") >= min_score) & (F.col("extraction_status") == K.NOT_STARTED)


def pending_fixes(fixes: DataFrame, commits: DataFrame) -> DataFrame:
    """Good fixes whose commit has not been read yet (a plain anti join: hashes are never NULL here)."""
    return fixes.filter(is_pending()).join(commits.select("hash"), "hash", "left_anti").select(*fixes.columns)


def fixed_pairs(pairs: DataFrame | ProductPairs, fixes: DataFrame) -> DataFrame:
    """(CVE, project) rows that already have a fix, letter case aside; of product pairs, their two columns only."""
    if isinstance(pairs, ProductPairs):
        known = fixes.select(F.col("cve_id").alias("cve"), F.col("repo_url").alias("project_url"))
        return pairs.among(known.dropna(), F.lower)
    known = fixes.select(F.lower("cve_id").alias("_cve"), F.lower("repo_url").alias("_url")).distinct()
    return pairs.join(
        known, (F.lower("cve") == F.col("_cve")) & (F.lower("project_url") == F.col("_url")), "left_semi"
    )


def missing_patches(fixes: DataFrame, stored: DataFrame) -> DataFrame:
    """Completed fixes whose patch file is not among the stored names."""
    done = fixes.filter((F.col("extraction_status") == K.COMPLETED) & (F.length("hash") > 5))
    named = done.select("hash", "repo_url", U.patch_name(F.col("repo_url"), F.col("hash")).alias("patch")).distinct()
    return named.join(stored, "patch", "left_anti")


def sample_per_repository(commits: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` random commits of every repository, drawn by a hash of id and seed; ties go to the smaller id."""
    drawn = commits.withColumn("_draw", F.md5(F.concat(F.col("commit_id"), F.lit(f"|{seed}"))))
    return top_k_per_key(drawn, ["repo_url"], [F.col("_draw"), F.col("commit_id")], n, "_rank").drop("_draw", "_rank")


def placeholder_repositories(repos: DataFrame) -> DataFrame:
    """Rows for repositories whose metadata is still to come."""
    unknown = ["repo_name", "description", "date_created", "date_last_push", "homepage", "repo_language", "forks_count", "stars_count"]
    return (
        repos.filter(F.contains("repo_url", F.lit("/")))
        .select("repo_url", *[F.lit("visit repo url").alias(c) for c in unknown],
                F.element_at(F.split("repo_url", "/"), -2).alias("owner"))
    )


# --- building the dataset -------------------------------------------------------------------------------


def build_cve_tables(spark: SparkSession, nvd: str, cwe: str) -> dict[str, DataFrame]:
    """``cve``, ``cwe`` and ``cwe_classification`` from the landed feeds."""
    cve = feeds.flatten_cve(feeds.read_nvd(spark, nvd))
    return {"cve": cve, "cwe": feeds.read_cwe(spark, cwe), "cwe_classification": feeds.weaknesses(cve)}


def replace_cve(spark: SparkSession, store: Store, path: str) -> int:
    """Replace ``cve`` and ``cwe_classification`` by the records of one own file, all values as text.

    The file is a feed (``vulnerabilities``) or a plain list of its records.  An id that stands in it twice is an error,
    and then nothing is replaced.
    """
    both = T.StructType([*S.NVD.fields, *S.NVD["vulnerabilities"].dataType.elementType.fields])
    rows = spark.read.schema(both).option("multiLine", True).json(path)
    nested = rows.select(F.explode("vulnerabilities").alias("v")).select("v.cve", "v.configurations")
    records = nested.unionByName(rows.select("cve", "configurations")).filter("cve.id IS NOT NULL")
    cve = feeds.flatten_cve(records)
    return store.commit({"cve": stringify(cve), "cwe_classification": feeds.weaknesses(cve)}, {"cve": ["cve_id"]})


def link_references(cve: DataFrame, packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``fixes`` and ``cve_project`` rows from the references of the CVEs."""
    fixes, projects = L.project_links(feeds.references(cve), packages)
    scored = fixes.withColumn("score", F.lit(K.REFERENCED_FIX_SCORE))
    return (
        conform(scored, S.FIXES, S.FIXES_DEFAULTS).dropDuplicates(S.FIXES_KEY),
        conform(projects, S.CVE_PROJECT, S.CVE_PROJECT_DEFAULTS).dropDuplicates(S.CVE_PROJECT_KEY),
    )


def link_advisories(advisories: DataFrame, packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fixes and project rows of every CVE alias of the advisories; one fix per CVE and repository."""
    links = L.advisory_links(feeds.advisory_refs(advisories), feeds.advisory_packages(advisories), packages)
    rows = advisories.select(F.col("id").alias("advisory_id"), F.explode("cve_ids").alias("cve_id")).join(links, "advisory_id")
    kind = F.concat(F.lit("GHSD_"), F.col("rel_type"))
    direct = F.col("rel_type") == K.DIRECT_COMMIT
    fixes = rows.filter(direct).select(
        "cve_id", U.commit_hash(F.col("link")).alias("hash"), U.commit_repo(F.col("link")).alias("repo_url"),
        kind.alias("rel_type"), F.lit(K.REFERENCED_FIX_SCORE).alias("score"), "advisory_id")
    first = first_per_key(fixes, ["cve_id", "repo_url"], [F.col("advisory_id")])
    projects = rows.filter(~direct).select(F.col("cve_id").alias("cve"), F.col("link").alias("project_url"), kind.alias("rel_type"))
    once = first_per_key(projects, S.CVE_PROJECT_KEY, [F.col("rel_type")])
    return conform(first, S.FIXES, S.FIXES_DEFAULTS), conform(once, S.CVE_PROJECT, S.CVE_PROJECT_DEFAULTS)


def link_cpe(dictionary: DataFrame, packages: DataFrame, cpe_of_cves: DataFrame, known_repos: DataFrame) -> DataFrame:
    """Repository of every product: best dictionary link, else a known repository of the same name."""
    best = L.best_links(dictionary, "cpe_name", packages).filter(F.col("link").isNotNull())
    direct = F.col("rel_type") == K.DIRECT_COMMIT
    linked = best.select(
        "cpe_name", F.when(direct, U.base_repo_url(F.col("link"))).otherwise(F.col("link")).alias("repo_url"), "rel_type")
    missing = cpe_of_cves.select("cpe_name").distinct().join(linked, "cpe_name", "left_anti")
    return linked.unionByName(L.guessed_repos(missing, known_repos))


def build_change_tables(changes: DataFrame, spans: DataFrame) -> dict[str, DataFrame]:
    """Commit, file and method tables from stored change records.

    ``changes``: ``hash, repo_url, msg, .., modified_files``; ``spans``: method spans ``(hash, old_path, new_path,
    side, name, signature, parameters, start_line, end_line)``.
    """
    files = file_rows(changes)
    keys = files.select("hash", "old_path", "new_path", "file_change_id")
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("old_path", "new_path")]
    placed = (
        spans.alias("s").join(keys.alias("k"), (F.col("s.hash") == F.col("k.hash")) & same[0] & same[1])
        .select("k.file_change_id", "s.side", "s.name", "s.signature", "s.parameters", "s.start_line", "s.end_line")
    )
    lines = diff_lines(files, "file_change_id", "diff").select("file_change_id", "side", "line")
    commits = first_per_key(
        changes.drop("modified_files").withColumn("repo_url", U.clean_git_url(F.col("repo_url"))), ["hash", "repo_url"], [F.col("msg")])
    return {"commits": commits, "file_change": files, "method_change": method_rows(files, placed, lines)}


# --- ranking ------------------------------------------------------------------------------------------------


def candidate_pairs(
    advisories: DataFrame, commits: DataFrame, weights: DataFrame, before: int, after: int, limit: int | None,
    twin_limit: int | None = None,
) -> DataFrame:
    """Candidates ``(cve_id, repo_url, commit_id, ts, position)`` of every advisory in one plan.

    Around the commits that the references name, whenever they were made; where the repository has none of them, around
    the reserved date, and for an advisory without a date the whole repository.  Filtered, cut to the nearest ``limit``
    if there is one, and joined by the named commits in the wide window around the date.  ``twin_limit`` narrows the
    window of a fix that has more commits around it; a pair with a fix for which no window is narrow enough gets the date
    window as well.
    """
    extension = F.transform("changed_files", lambda f: F.element_at(F.split(f, r"\."), -1))
    narrow = commits.select("commit_id", "repo_url", "ts", F.array_distinct(extension).alias("_ext"),
                            C.is_candidate(F.col("message"), F.col("changed_files")).alias("_usable"))
    slim = advisories.select("cve_id", "repo_url", "reserved", "extensions")
    wanted = (F.size("extensions") == 0) | F.arrays_overlap("_ext", "extensions")
    named_refs = L.fixing_commits(weights).select("cve_id", F.concat(F.lit("commit::"), "commit_id").alias("ref"))
    named = cut_lineage(C.mentioned(named_refs, slim, narrow, None))
    known = named.select("cve_id", "repo_url", F.col("ts").alias("author_ts"), F.col("ts").alias("commit_ts")).distinct()
    usable = narrow.filter("_usable")
    columns = ["cve_id", "repo_url", "commit_id", "ts", "reserved"]
    windows = C.twin_window(known, narrow, twin_limit)
    around_fix = windows.filter("_usable").join(slim, R.PAIR).select(*columns)
    closed = slim.join(around_fix.select(*R.PAIR).distinct(), R.PAIR, "left_anti")
    if twin_limit is not None:
        without = known.join(windows.select(*known.columns).distinct(), known.columns, "left_anti").select(*R.PAIR)
        closed = closed.unionByName(slim.join(without, R.PAIR, "left_semi")).distinct()
    around_date = C.within_days(closed.filter("reserved IS NOT NULL"), usable, before, after).filter(wanted).select(*columns)
    undated = closed.filter("reserved IS NULL").join(usable, "repo_url").filter(wanted).select(*columns)
    near = C.nearest(around_fix.unionByName(around_date).unionByName(undated).distinct(), limit).drop("reserved")
    gap = F.abs(F.unix_timestamp("ts") - F.unix_timestamp("reserved"))
    wide = K.WINDOW_DAYS * K.MENTIONED_WINDOW_FACTOR * K.DAY_SECONDS
    extra = (
        named.filter(F.coalesce(gap <= wide, F.lit(True))).select("cve_id", "repo_url", "commit_id", "ts").distinct()
        .join(near, [*R.PAIR, "commit_id"], "left_anti")
    )
    last = -F.unix_timestamp("ts") if limit is None else F.lit(limit + 1)
    return near.withColumn("position", F.col("position").cast("long")).unionByName(extra.withColumn("position", last.cast("long")))


def shuffled_work(pending: DataFrame, keys: Sequence[str], seed: int, most: int | None = None) -> DataFrame:
    """Pending rows in an order drawn by seed, as column ``draw``; the first ``most`` of them if given.

    The draw is a hash of key and seed, so reruns agree however the rows are partitioned.
    """
    drawn = pending.withColumn("draw", F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))))
    return drawn if most is None else drawn.orderBy("draw", *keys).limit(most)


def rank_candidates(
    advisories: DataFrame, commits: DataFrame, weights: DataFrame, issues: DataFrame, tickets: DataFrame,
    rules: Sequence[str] = ("ALL",), before: int = K.WINDOW_DAYS, after: int = K.WINDOW_DAYS,
    limit: int | None = None, message_chars: int | None = None, twin_limit: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Ranked commits of every (CVE, repository) and the twins of the kept ones.

    ``advisories``: ``cve_id, repo_url, reserved, keywords, files, extensions, references``; ``commits``:
    ``commit_id, repo_url, ts, message, changed_files, diff``; ``issues`` and ``tickets``: ``repository, issue_id,
    content``.  ``message_chars`` cuts messages before twins are looked for; by default whole messages count.  The result
    has ids, position, relevance, matched rules and rank; ``commit_details`` adds what reports show of a commit.
    """
    # pairs, bands and scores feed several later steps; reliable checkpoints keep them from being computed again
    pairs = cut_lineage(candidate_pairs(advisories, commits, weights, before, after, limit, twin_limit))
    used = commits.join(pairs.select("repo_url", "commit_id").distinct(), ["repo_url", "commit_id"], "left_semi")
    with_twins = bool({"ALL", "COMMIT_HAS_TWINS"} & set(rules))  # nothing counts as a twin without that rule
    if with_twins:
        of_repository = TW.band_rows(
            used.filter(~F.col("message").startswith("Merge")), ["repo_url"], "commit_id", "message", message_chars)
        bands = TW.bands_of_scopes(pairs.select(*R.PAIR, "commit_id"), of_repository, R.PAIR, ["repo_url"], "commit_id")
        twins = TW.with_twins(bands, R.PAIR, "commit_id").withColumn("has_twins", F.lit(True))
        flagged = pairs.join(twins, [*R.PAIR, "commit_id"], "left").withColumn("has_twins", F.coalesce("has_twins", F.lit(False)))
    else:
        flagged = pairs.withColumn("has_twins", F.lit(False))
    scored = RU.score_pairs(
        flagged.withColumnRenamed("repo_url", "repository"), _features(used, issues, tickets),
        advisories.withColumnRenamed("repo_url", "repository"), rules)
    ranked = cut_lineage(R.rank(scored.withColumnRenamed("repository", "repo_url"), F.col("position")))
    if not with_twins:
        return ranked, ranked.limit(0).select(*R.PAIR, "commit_id", F.col("commit_id").alias("twin"))
    kept = TW.remove_twins(ranked, bands, R.PAIR, "commit_id", "rank")
    return kept, TW.twins_of_kept(kept, bands, R.PAIR, "commit_id")


def _features(commits: DataFrame, issues: DataFrame, tickets: DataFrame) -> DataFrame:
    renamed = commits.withColumnRenamed("repo_url", "repository").withColumn("changed_files", C.relevant_files(F.col("changed_files")))
    return RU.commit_features(renamed.drop("ts"), issues, tickets)


def commit_details(kept: DataFrame, commits: DataFrame, issues: DataFrame, tickets: DataFrame) -> DataFrame:
    """Ranked commits with message, files, changes and linked pages, for reports."""
    ids = kept.select("repo_url", "commit_id").distinct()
    details = _features(commits.join(ids, ["repo_url", "commit_id"], "left_semi"), issues, tickets)
    return kept.join(details.withColumnRenamed("repository", "repo_url"), ["repo_url", "commit_id"])
