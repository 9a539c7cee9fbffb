"""From reference urls to repositories and fixing commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake import constants as K
from vulnlake.functions import urls as U
from vulnlake.operators.keyed import first_per_key, top_k_per_key


def newest_versions(versions: DataFrame, as_of: str | None = None) -> DataFrame:
    """Newest version per package ``(ecosystem, name, version)``: the last of its list, ``versions`` having ``pos``.

    With ``as_of``, the last one that was ``published`` by then.
    """
    rows = versions if as_of is None else versions.filter(F.col("published") <= F.to_timestamp(F.lit(as_of)))
    last = F.max(F.struct("pos", "version"))["version"]
    return rows.groupBy("ecosystem", "name").agg(last.alias("version"))


def package_repos(links: DataFrame, versions: DataFrame | None = None, as_of: str | None = None) -> DataFrame:
    """One repository per package ``(ecosystem, name, repo_url)`` from the links of its packages.

    The source link goes first, then any link to a GitHub repository; a gem needs its name in the link.  With the
    packages' ``versions (ecosystem, name, pos, version)``, only links of the newest version count in the ecosystems
    that list links by version; the others (gems, composer) have one set of links.
    """
    if versions is not None:
        listed = F.col("ecosystem").isin(K.DIRECT_ECOSYSTEMS)
        newest = newest_versions(versions, as_of)
        links = links.filter(listed).join(newest, ["ecosystem", "name", "version"], "left_semi").select(*links.columns).unionByName(
            links.filter(F.coalesce(~listed, F.lit(True))))
    cleaned = U.clean_git_url(F.col("url"))
    repo = F.when(F.col("label") == "SOURCE_REPO", cleaned).otherwise(U.base_repo_url(cleaned))
    named = (F.col("ecosystem") != "RUBYGEMS") | F.col("url").contains(F.col("name"))
    usable = links.select(
        "ecosystem", "name", repo.alias("repo_url"), (F.col("label") != "SOURCE_REPO").alias("_late")
    ).filter(named & U.is_github_repo(F.col("repo_url")))
    return first_per_key(usable, ["ecosystem", "name"], [F.col("_late"), F.col("repo_url")]).drop("_late")


def link_candidates(
    refs: DataFrame, packages: DataFrame | None = None, resource_only: bool = False
) -> DataFrame:
    """Every usable or blacklisted link ``(.., pos, url, link, rel_type, class, blacklisted)``.

    Class 1 is a direct commit, 2 a GitHub repository, 3 a registry page that resolves to one.  Only registry
    rows meet the package table, so references without a package never share a shuffle key.
    """
    url = F.col("url")
    commit = url.rlike(K.COMMIT_URL)
    own = U.github_base(U.resource_repo(url) if resource_only else url)
    other_host = U.github_base(url, www=True)
    direct = (
        refs.withColumn("link", F.when(commit, url).otherwise(F.coalesce(own, other_host)))
        .withColumn("class", F.when(commit, 1).when(own.isNotNull(), 2).otherwise(3))
        .filter(F.col("link").isNotNull())
    )
    found = direct
    if packages is not None:
        registry = (
            refs.withColumn("ecosystem", U.registry_ecosystem(url))
            .filter(F.col("ecosystem").isNotNull() & (F.col("ecosystem") != "GITHUB"))
            .withColumn("name", U.package_name(url))
            .join(packages, ["ecosystem", "name"])
            .withColumn("link", F.col("repo_url"))
            .withColumn("class", F.lit(3))
            .drop("ecosystem", "name", "repo_url")
        )
        found = direct.unionByName(registry)
    rel_type = (
        F.when(F.col("class") == 1, K.DIRECT_COMMIT).when(F.col("class") == 2, K.REPO_BASED).otherwise(K.REGISTRY)
    )
    return found.withColumn("rel_type", rel_type).withColumn(
        "blacklisted", (F.col("class") > 1) & U.is_blacklisted(F.col("link"))
    )


def best_links(
    refs: DataFrame, key: str, packages: DataFrame | None = None, resource_only: bool = False
) -> DataFrame:
    """Best link per key ``(key, link, rel_type, blacklisted)``.

    ``blacklisted`` counts the links passed over before the best one; a key with only such links keeps a row
    without a link.
    """
    found = link_candidates(refs.select(key, "pos", "url"), packages, resource_only)
    order = F.struct("class", "pos", "link", "rel_type")
    best = found.groupBy(key).agg(F.min(F.when(~F.col("blacklisted"), order)).alias("best"))
    passed = (
        found.filter("blacklisted")
        .join(best, key)
        .filter(F.col("best").isNull() | (F.struct("class", "pos") < F.struct("best.class", "best.pos")))
        .groupBy(key)
        .agg(F.count("*").alias("blacklisted"))
    )
    return best.join(passed, key, "left").select(
        key,
        F.col("best.link").alias("link"),
        F.col("best.rel_type").alias("rel_type"),
        F.coalesce("blacklisted", F.lit(0)).cast("long").alias("blacklisted"),
    )


def direct_commits(refs: DataFrame, key: str = "cve_id", source: str = "NVD") -> DataFrame:
    """Commit links as fixes ``(key, hash, repo_url, rel_type)``, one row per link."""
    url = F.col("url")
    return refs.select(
        key,
        U.commit_hash(url).alias("hash"),
        U.commit_repo(url).alias("repo_url"),
        F.lit(f"{source}_{K.DIRECT_COMMIT}").alias("rel_type"),
    ).filter(F.col("hash").isNotNull())


def project_links(refs: DataFrame, packages: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Fixes of the CVEs that have commit links, and one project link for each of the others."""
    fixes = direct_commits(refs)
    others = refs.join(fixes.select("cve_id").distinct(), "cve_id", "left_anti")
    projects = (
        best_links(others, "cve_id", packages)
        .filter(F.col("link").isNotNull())
        .select(
            F.col("cve_id").alias("cve"),
            F.col("link").alias("project_url"),
            F.concat(F.lit("NVD_"), F.col("rel_type")).alias("rel_type"),
        )
    )
    return fixes, projects


def advisory_links(refs: DataFrame, affected: DataFrame, packages: DataFrame) -> DataFrame:
    """Link per advisory ``(advisory_id, link, rel_type)``: its pages first, then its first package.

    ``affected`` has ``(advisory_id, pos, ecosystem, name)``.
    """
    from_refs = (
        best_links(refs, "advisory_id", packages, resource_only=True)
        .filter(F.col("link").isNotNull())
        .withColumn("rel_type", F.when(F.col("rel_type") == K.REGISTRY, K.REPO_BASED).otherwise(F.col("rel_type")))
        .select("advisory_id", "link", "rel_type")
    )
    first = first_per_key(
        affected.filter(F.col("name").isNotNull()).withColumn("ecosystem", U.normal_ecosystem(F.col("ecosystem"))),
        ["advisory_id"], [F.col("pos")],
    )
    from_packages = (
        first.filter(F.col("ecosystem").isNotNull())
        .join(packages, ["ecosystem", "name"])
        .select("advisory_id", F.col("repo_url").alias("link"), F.lit(K.REGISTRY).alias("rel_type"))
        .join(from_refs, "advisory_id", "left_anti")
    )
    return from_refs.unionByName(from_packages)


def reference_weights(own: DataFrame, third_party: DataFrame, page_links: DataFrame) -> DataFrame:
    """Weight per ``(cve_id, ref)``: 2 if the advisory has it, plus 2 per tracker link, 1 per page link."""
    url = U.commit_reference(F.col("url")).alias("ref")
    parts = [
        own.select("cve_id", url, F.lit(2).alias("w")).distinct(),
        third_party.select("cve_id", url, F.lit(2).alias("w")),
        page_links.select("cve_id", url, F.lit(1).alias("w")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("cve_id", "ref").agg(F.sum("w").alias("weight"))


def fixing_commits(weights: DataFrame, most: int | None = None) -> DataFrame:
    """Commit references of a CVE; with ``most``, at most so many: those heavier than the next one in line."""
    commits = weights.filter(F.col("ref").startswith("commit::"))
    if most is None:
        return commits.select("cve_id", F.expr("substring(ref, 9)").alias("commit_id"), "weight")
    limit = (
        top_k_per_key(commits, ["cve_id"], [F.desc("weight"), F.col("ref")], most + 1)
        .filter(F.col("rank") == most + 1)
        .select("cve_id", F.col("weight").alias("_limit"))
    )
    return (
        commits.join(limit, "cve_id", "left")
        .filter(F.col("_limit").isNull() | (F.col("weight") > F.col("_limit")))
        .select("cve_id", F.expr("substring(ref, 9)").alias("commit_id"), "weight")
    )


def guessed_repos(cpe_names: DataFrame, known_repos: DataFrame) -> DataFrame:
    """CPE names whose ``vendor/product`` is a known repository ``(cpe_name, repo_url, rel_type)``."""
    name = F.trim("cpe_name")
    guess = cpe_names.select(
        name.alias("cpe_name"), F.concat(F.lit("https://github.com/"), F.replace(name, F.lit(":"), F.lit("/"))).alias("repo_url")
    ).filter(F.col("cpe_name") != "")
    return guess.distinct().join(known_repos, "repo_url", "left_semi").select(
        "cpe_name", "repo_url", F.lit(K.CPE_SEARCH).alias("rel_type")
    )


def unavailable(status: DataFrame) -> DataFrame:
    """Urls that answer with an error or send the reader to a sign-in page."""
    bad = (F.col("status") >= 400) | (
        F.col("status").between(300, 399) & F.coalesce(F.col("location") == K.SIGN_IN_PAGE, F.lit(False))
    )
    return status.filter(F.col("url").rlike("^https?://") & bad)


def repo_state(status: Column) -> Column:
    return F.when(status == 200, "Available").when(status == 429, "Unavailable").otherwise("Removed")
