"""Queries of link resolution, predicates and small projections."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnlake import constants as K
from vulnlake.catalog import sqltext as Q
from vulnlake.catalog.registry import query
from vulnlake.functions import text as X
from vulnlake.functions import urls as U
from vulnlake.operators import links as L
from vulnlake.operators import tables as TB

URL = F.col


def _url():
    return F.col("url")


@query("lnk_01_best_link", Q.BEST_LINK)
def _(d):
    return L.best_links(d("v_ref"), "cve_id", L.package_repos(d("v_package_links")))


@query("agg_12_blacklisted_links", f"SELECT cve_id, count(*) AS n FROM {Q.LINKS} WHERE black GROUP BY cve_id")
def _(d):
    found = L.link_candidates(d("v_ref"), L.package_repos(d("v_package_links")))
    return found.filter("blacklisted").groupBy("cve_id").agg(F.count("*").alias("n"))


@query("lnk_02_direct_commits", f"""
    SELECT cve_id, regexp_extract(url, '{Q.COMMIT_RE}', 2) AS hash,
           regexp_replace(regexp_extract(url, '{Q.COMMIT_RE}', 1), '^http:', 'https:') AS repo_url,
           'NVD_DIRECT_COMMIT' AS rel_type
    FROM v_ref WHERE regexp_matches(url, '{Q.COMMIT_RE}')""")
def _(d):
    return L.direct_commits(d("v_ref"))


@query("lnk_03_project_links", f"""
    WITH b AS ({Q.BEST_LINK})
    SELECT cve_id AS cve, link AS project_url, 'NVD_' || rel_type AS rel_type FROM b
    WHERE link IS NOT NULL AND rel_type <> 'DIRECT_COMMIT'""")
def _(d):
    return L.project_links(d("v_ref"), L.package_repos(d("v_package_links")))[1]


@query("lnk_05_resource_repositories", f"""
    SELECT page_id, url, regexp_replace(nullif(regexp_extract(url, '{Q.RESOURCE_RE}', 1), ''), '^http:', 'https:') AS repo
    FROM (SELECT pos AS page_id, url FROM v_ref)""")
def _(d):
    return d("v_ref").select(F.col("pos").alias("page_id"), "url", U.resource_repo(_url()).alias("repo"))


@query("lnk_06_base_urls", f"SELECT page_id, {Q.base('url')} AS base FROM pages")
def _(d):
    return d("pages").select("page_id", U.base_repo_url(_url()).alias("base"))


@query("lnk_07_is_repository", f"SELECT pos, {Q.is_repo('url')} AS is_repo FROM v_ref")
def _(d):
    return d("v_ref").select("pos", U.is_github_repo(_url()).alias("is_repo"))


@query("lnk_08_clean_git_urls", f"SELECT page_id, {Q.clean_git('url')} AS clean FROM v_git_url")
def _(d):
    return d("v_git_url").select("page_id", U.clean_git_url(_url()).alias("clean"))


@query("lnk_09_owner_and_name", r"""
    SELECT page_id, nullif(regexp_extract(url, '^[a-z]+://github\.com/+([^/?#]+)/+[^/?#]+', 1), '') AS owner,
           regexp_replace(nullif(regexp_extract(url, '^[a-z]+://github\.com/+[^/?#]+/+([^/?#]+)', 1), ''), '\.git$', '') AS name
    FROM v_git_url""")
def _(d):
    return d("v_git_url").select("page_id", U.github_owner(_url()).alias("owner"), U.github_name(_url()).alias("name"))


@query("lnk_10_without_query", "SELECT page_id, regexp_replace(url, '[?#].*$', '') AS clean FROM pages")
def _(d):
    return d("pages").select("page_id", U.without_query(_url()).alias("clean"))


@query("lnk_11_registry_of_url", f"SELECT page_id, {Q.ecosystem('url')} AS ecosystem FROM v_registry_url")
def _(d):
    return d("v_registry_url").select("page_id", U.registry_ecosystem(_url()).alias("ecosystem"))


@query("lnk_12_package_of_url", f"SELECT page_id, {Q.package('url')} AS package FROM v_registry_url")
def _(d):
    return d("v_registry_url").select("page_id", U.package_name(_url()).alias("package"))


@query("lnk_13_normal_ecosystems", """
    SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'PYPI' WHEN 1 THEN 'CARGO' WHEN 2 THEN 'RUBYGEMS' WHEN 3 THEN 'COMPOSER'
      WHEN 4 THEN 'NPM' END AS ecosystem FROM pages""")
def _(d):
    names = F.array(*[F.lit(n) for n in ("pip", "crates.io", "RubyGems", "Packagist", "npm", "Hex")])
    raw = F.get(names, (F.col("page_id") % 6).cast("int"))
    return d("pages").select("page_id", U.normal_ecosystem(raw).alias("ecosystem"))


@query("lnk_14_package_repositories", f"SELECT * FROM {Q.PACKAGE_REPOS}")
def _(d):
    return L.package_repos(d("v_package_links"))


REF = r"""CASE
    WHEN contains(url, 'a=commit;') AND regexp_matches(url, ';h=\w{6,40}')
      THEN 'commit::' || regexp_extract(url, ';h=(\w{6,40})', 1)
    WHEN regexp_matches(url, 'commits?/\w{6,40}') THEN 'commit::' || regexp_extract(url, 'commits?/(\w{6,40})', 1)
    WHEN regexp_matches(url, '(?:commit|patch)/\?id=\w{6,40}')
      THEN 'commit::' || regexp_extract(url, '(?:commit|patch)/\?id=(\w{6,40})', 1)
    ELSE url END"""
REFS = """(SELECT pos, cve_id, CASE WHEN pos % 17 = 0 THEN 'https://git.example.org/?p=x.git;a=commit;h=' || md5(url)
             WHEN pos % 19 = 0 THEN 'https://git.example.org/x.git/commit/?id=' || md5(url) ELSE url END AS url FROM v_ref)"""


NEWEST = "(SELECT ecosystem, name, arg_max(version, (pos, version)) AS version FROM v_package_release GROUP BY 1, 2)"


@query("srt_09_newest_versions", f"SELECT * FROM {NEWEST}")
def _(d):
    return L.newest_versions(d("v_package_release"))


@query("lnk_14_newest_package_repositories", f"""
    SELECT ecosystem, name, arg_min(repo, (late, repo)) AS repo_url FROM (
      SELECT r.ecosystem, r.name, label <> 'SOURCE_REPO' AS late, url,
             CASE WHEN label = 'SOURCE_REPO' THEN {Q.clean_git('url')} ELSE {Q.base(Q.clean_git('url'))} END AS repo
      FROM v_package_release r JOIN {NEWEST} n ON n.ecosystem = r.ecosystem AND n.name = r.name
      WHERE r.ecosystem NOT IN ('PYPI', 'NPM') OR r.version = n.version)
    WHERE {Q.is_repo('repo')} AND (ecosystem <> 'RUBYGEMS' OR contains(url, name)) GROUP BY 1, 2""")
def _(d):
    releases = d("v_package_release")
    return L.package_repos(releases, releases.select("ecosystem", "name", "pos", "version").distinct())


@query("lnk_16_commit_references", f"SELECT pos, {REF} AS ref FROM {REFS}")
def _(d):
    return d.sql(f"SELECT * FROM {REFS}").select("pos", U.commit_reference(_url()).alias("ref"))


WEIGHTS = f"""
    SELECT cve_id, ref, sum(w)::BIGINT AS weight FROM (
      SELECT DISTINCT cve_id, {REF} AS ref, 2 AS w FROM v_ref
      UNION ALL SELECT cve_id, {REF} AS ref, 2 FROM (SELECT cve_id, url FROM v_ref WHERE contains(url, 'github'))
      UNION ALL SELECT cve_id, {REF} AS ref, 1 FROM v_ref) GROUP BY cve_id, ref"""


def _weights(d):
    refs = d("v_ref")
    return L.reference_weights(refs, refs.filter(_url().contains("github")), refs)


@query("lnk_17_reference_weights", WEIGHTS)
def _(d):
    return _weights(d)


@query("agg_13_reference_counter", "SELECT cve_id, url, count(*) AS n FROM v_ref GROUP BY cve_id, url")
def _(d):
    return d("v_ref").groupBy("cve_id", "url").agg(F.count("*").alias("n"))


LINE_WEIGHTS = """(SELECT cve_id, 'commit::' || hash AS ref, sum(score)::BIGINT AS weight FROM v_fixes GROUP BY 1, 2)"""


@query("lnk_18_fixing_commits", f"""
    WITH w AS (SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY weight DESC, ref) AS rn FROM {LINE_WEIGHTS})
    SELECT cve_id, substr(ref, 9) AS commit_id, weight FROM w
    WHERE weight > coalesce((SELECT x.weight FROM w x WHERE x.cve_id = w.cve_id AND x.rn = 6), -1)""")
def _(d):
    weights = d("v_fixes").groupBy("cve_id", F.concat(F.lit("commit::"), F.col("hash")).alias("ref")).agg(
        F.sum("score").alias("weight"))
    return L.fixing_commits(weights, K.FIX_REF_LIMIT)


@query("win_08_sixth_weight", f"""
    SELECT cve_id, weight FROM (
      SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY weight DESC, ref) AS rn FROM {LINE_WEIGHTS}) WHERE rn = 6""")
def _(d):
    from vulnlake.operators.keyed import top_k_per_key

    weights = d("v_fixes").groupBy("cve_id", F.concat(F.lit("commit::"), F.col("hash")).alias("ref")).agg(
        F.sum("score").alias("weight"))
    return top_k_per_key(weights, ["cve_id"], [F.desc("weight"), F.col("ref")], 6).filter("rank = 6").select("cve_id", "weight")


@query("srt_08_references_by_weight", f"""
    SELECT cve_id, ref, weight, row_number() OVER (ORDER BY cve_id, weight DESC, ref) AS pos FROM ({WEIGHTS})""")
def _(d):
    from vulnlake.operators.keyed import with_position

    return with_position(_weights(d), [F.col("cve_id"), F.desc("weight"), F.col("ref")])


@query("lnk_19_commit_pages", """
    SELECT hash, CASE WHEN contains(r, 'gitlab.') THEN r || '/-/commit/' || hash ELSE r || '/commit/' || hash END AS page
    FROM (SELECT hash, CASE WHEN contains(repo_url, '.git') THEN replace(repo_url, 'github.', 'gitlab.') ELSE repo_url END AS r
          FROM v_commits)""")
def _(d):
    repo = F.when(F.contains("repo_url", F.lit(".git")), F.replace("repo_url", F.lit("github."), F.lit("gitlab."))).otherwise(F.col("repo_url"))
    return d("v_commits").select("hash", U.commit_page(repo, F.col("hash")).alias("page"))


@query("lnk_20_flat_names", f"""
    SELECT page_id, regexp_extract(u, '^[a-z]+://([^/?#]*)', 1) || replace({Q.path('u')}, '/', '_') AS name
    FROM (SELECT page_id, regexp_replace(url, '/+$', '') AS u FROM pages)""")
def _(d):
    return d("pages").select("page_id", U.flat_name(_url()).alias("name"))


@query("lnk_21_redirected_urls", """
    SELECT p.page_id, coalesce(s.location, p.url) AS final_url FROM pages p
    LEFT JOIN (SELECT page_id, location FROM v_url_status WHERE status = 302) s ON s.page_id = p.page_id""")
def _(d):
    moved = d("v_url_status").filter("status = 302").select("page_id", "location")
    return d("pages").join(moved, "page_id", "left").select("page_id", F.coalesce("location", "url").alias("final_url"))


@query("lnk_22_unavailable_urls", """
    SELECT page_id, url FROM v_url_status WHERE regexp_matches(url, '^https?://')
      AND (status >= 400 OR (status BETWEEN 300 AND 399 AND location = 'https://gitlab.com/users/sign_in'))""")
def _(d):
    return L.unavailable(d("v_url_status")).select("page_id", "url")


@query("lnk_23_repository_state", """
    SELECT page_id, CASE status WHEN 200 THEN 'Available' WHEN 429 THEN 'Unavailable' ELSE 'Removed' END AS state
    FROM v_url_status""")
def _(d):
    return d("v_url_status").select("page_id", L.repo_state(F.col("status")).alias("state"))


# --- predicates ---------------------------------------------------------------------------------------


@query("prj_10_blacklisted_urls", f"SELECT pos, {Q.blacklisted('url')} AS black FROM (SELECT pos, {Q.base('url')} AS url FROM v_ref)")
def _(d):
    return d("v_ref").select("pos", U.is_blacklisted(U.base_repo_url(_url())).alias("black"))


@query("prj_13_allowed_hosts", f"SELECT pos, regexp_matches({Q.host('url')}, '{Q.HOSTS}') AS allowed FROM v_ref")
def _(d):
    return d("v_ref").select("pos", U.is_allowed_host(_url()).alias("allowed"))


@query("prj_25_github_references", "SELECT pos, url FROM v_ref WHERE contains(url, 'github.com')")
def _(d):
    return d("v_ref").filter(_url().contains("github.com")).select("pos", "url")


@query("prj_22_valid_urls", "SELECT page_id, url FROM v_git_url WHERE regexp_matches(url, '^https?://')")
def _(d):
    return d("v_git_url").filter(_url().rlike("^https?://")).select("page_id", "url")


@query("prj_14_cves_of_years", """
    SELECT cve_id FROM v_cve WHERE cve_id ILIKE 'CVE-1997-%' OR cve_id ILIKE 'CVE-2000-%'""")
def _(d):
    return d("v_cve").filter(F.split("cve_id", "-")[1].isin("1997", "2000")).select("cve_id")


@query("prj_15_advisories_not_rejected", "SELECT cve_id, state FROM v_cve WHERE state <> 'REJECTED'")
def _(d):
    return d("v_cve").filter(F.col("state") != "REJECTED").select("cve_id", "state")


@query("prj_07_textual_changes", "SELECT file_change_id FROM v_file_change WHERE NOT (num_lines_added = 0 AND num_lines_deleted = 0)")
def _(d):
    return d("v_file_change").filter((F.col("num_lines_added") != 0) | (F.col("num_lines_deleted") != 0)).select("file_change_id")


@query("prj_09_work_selection", "SELECT * FROM v_fixes WHERE score >= 65 AND extraction_status = 'NOT_STARTED'")
def _(d):
    from vulnlake.plans.jobs import is_pending

    return d("v_fixes").filter(is_pending())


@query("prj_20_description_predicates", """
    SELECT cve_id, description FROM v_cve WHERE (description ILIKE '%INJECTION%' OR description ILIKE 'red %')
      AND description NOT ILIKE '%promo%'""")
def _(d):
    text = F.col("description")
    return d("v_cve").filter((text.ilike("%INJECTION%") | text.ilike("red %")) & ~text.ilike("%promo%")).select("cve_id", "description")


@query("prj_23_methods_of_language", """
    SELECT m.method_change_id, f.filename FROM v_method_change m JOIN v_file_change f ON f.file_change_id = m.file_change_id
    WHERE f.programming_language = 'C'""")
def _(d):
    files = d("v_file_change").filter("programming_language = 'C'").select("file_change_id", "filename")
    return d("v_method_change").join(files, "file_change_id").select("method_change_id", "filename")


@query("prj_23_diffs_with_fragment", r"""
    SELECT file_change_id, diff FROM v_file_change WHERE diff ILIKE '%replace(/<3/g,%' AND new_path NOT ILIKE '%test%'""")
def _(d):
    return d("v_file_change").filter(
        F.col("diff").ilike("%replace(/<3/g,%") & ~F.col("new_path").ilike("%test%")).select("file_change_id", "diff")


@query("prj_08_placeholder_repositories", """
    SELECT repo_url, 'visit repo url' AS repo_name, 'visit repo url' AS description, string_split(repo_url, '/')[-2] AS owner
    FROM v_repo WHERE repo_url NOT IN (SELECT repo_url FROM v_repository)""")
def _(d):
    from vulnlake.plans.jobs import placeholder_repositories

    unknown = d("v_repo").join(d("v_repository"), "repo_url", "left_anti")
    return placeholder_repositories(unknown).select("repo_url", "repo_name", "description", "owner")


# --- table shapes ---------------------------------------------------------------------------------------


@query("prj_03_conformed_table", """
    SELECT file_change_id, hash, cast(num_lines_added AS bigint) AS num_lines_added, cast(NULL AS varchar) AS author,
           'unknown' AS origin FROM v_file_change""")
def _(d):
    schema = T.StructType([
        T.StructField("file_change_id", T.StringType()), T.StructField("hash", T.StringType()),
        T.StructField("num_lines_added", T.LongType()), T.StructField("author", T.StringType()),
        T.StructField("origin", T.StringType()),
    ])
    return TB.conform(d("v_file_change"), schema, {"origin": "unknown"})


@query("prj_04_all_text", """
    SELECT repo_url, coalesce(cast(commits_count AS varchar), 'None') AS commits_count FROM v_repository""")
def _(d):
    return TB.stringify(d("v_repository"))


RAW = """(SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN 'None' WHEN o_custkey % 4 = 1 THEN cast(o_custkey AS string) || '.5'
           WHEN o_custkey % 4 = 2 THEN '-' || cast(o_custkey AS string) ELSE '' END AS raw FROM orders)"""


@query("prj_05_safe_casts", rf"""
    SELECT o_orderkey, CASE WHEN regexp_full_match(raw, '-?[0-9]+') THEN try_cast(raw AS integer) END AS as_int,
           CASE WHEN regexp_full_match(raw, '-?[0-9]+(\.[0-9]+)?') THEN try_cast(raw AS double) END AS as_double FROM {RAW}""")
def _(d):
    raw = F.col("raw")
    return d.sql(f"SELECT * FROM {RAW}").select(
        "o_orderkey", TB.safe_int(raw).alias("as_int"), TB.safe_double(raw).alias("as_double"))


@query("prj_06_without_sentinels", f"SELECT o_orderkey, raw FROM {RAW} WHERE raw NOT IN ('', 'None') AND raw IS NOT NULL")
def _(d):
    return d.sql(f"SELECT * FROM {RAW}").filter(X.blank_to_null(F.col("raw")).isNotNull())


@query("snk_03_insert_ignore", """
    SELECT cve_id, repo_url, hash, rel_type, score FROM (
      SELECT *, row_number() OVER (PARTITION BY cve_id, repo_url, hash ORDER BY score DESC, rel_type) AS rn FROM v_fixes
      WHERE extraction_status = 'NOT_STARTED')
    WHERE rn = 1 AND (cve_id, repo_url, hash) NOT IN (
      SELECT (cve_id, repo_url, hash) FROM v_fixes WHERE extraction_status = 'COMPLETED')
    UNION ALL SELECT cve_id, repo_url, hash, rel_type, score FROM v_fixes WHERE extraction_status = 'COMPLETED'""")
def _(d):
    fixes = d("v_fixes").select("cve_id", "repo_url", "hash", "rel_type", "score", "extraction_status")
    old = fixes.filter("extraction_status = 'COMPLETED'").drop("extraction_status")
    new = fixes.filter("extraction_status = 'NOT_STARTED'").drop("extraction_status")
    return TB.insert_ignore(old, new, ["cve_id", "repo_url", "hash"], [-F.col("score"), F.col("rel_type")])


@query("snk_04_upsert", """
    WITH n AS (SELECT repo_url, count(DISTINCT hash) AS commits_count FROM v_fixes GROUP BY repo_url)
    SELECT repo_url, commits_count FROM n
    UNION ALL SELECT repo_url, commits_count FROM v_repository WHERE repo_url NOT IN (SELECT repo_url FROM n)""")
def _(d):
    new = d("v_fixes").groupBy("repo_url").agg(F.countDistinct("hash").alias("commits_count"))
    return TB.upsert(d("v_repository"), new, ["repo_url"], [F.col("commits_count")])


@query("snk_11_delete_low_scores", "SELECT cve_id, hash, score FROM v_fixes WHERE score >= 65")
def _(d):
    return TB.delete_where(d("v_fixes").select("cve_id", "hash", "score"), F.col("score") < K.MIN_FIX_SCORE)


@query("snk_12_update_status", """
    SELECT cve_id, hash, CASE WHEN extraction_status = 'NOT_STARTED' AND repo_url IN
      (SELECT repo_url FROM v_repository WHERE commits_count IS NULL) THEN 'REPO_REMOVED' ELSE extraction_status END AS extraction_status
    FROM v_fixes""")
def _(d):
    gone = d("v_repository").filter(F.col("commits_count").isNull()).select("repo_url", F.lit(True).alias("gone"))
    fixes = d("v_fixes").join(gone, "repo_url", "left")
    hit = F.col("gone") & (F.col("extraction_status") == K.NOT_STARTED)
    return TB.update_where(fixes, hit, extraction_status=F.lit("REPO_REMOVED")).select("cve_id", "hash", "extraction_status")


@query("snk_13_strip_git", r"SELECT hash, regexp_replace(repo_url, '\.git$', '') AS repo_url FROM v_commits")
def _(d):
    from vulnlake.operators.pruning import strip_git

    return strip_git(d("v_commits")).select("hash", "repo_url")


@query("src_15_page_links", r"""
    SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1)) AS link FROM pages""")
def _(d):
    return d("pages").select("page_id", F.explode(X.page_links(F.col("html"))).alias("link"))


@query("src_16_page_text", r"""
    SELECT page_id, replace(replace(replace(replace(replace(replace(
      regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS text FROM pages""")
def _(d):
    return d("pages").select("page_id", X.html_text(F.col("html")).alias("text"))


@query("prj_25_github_page_links", r"""
    SELECT page_id, link FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1)) AS link
      FROM (SELECT page_id, replace(html, 'href="/', 'href="https://github.com/') AS html FROM pages))
    WHERE regexp_matches(link, '^https://(github\.com|issues\.apache\.org/jira)')""")
def _(d):
    from vulnlake.sources.pages import code_links

    stored = d("pages").select("page_id", F.replace("html", F.lit('href="/'), F.lit('href="https://github.com/')).alias("html"))
    return code_links(stored)
