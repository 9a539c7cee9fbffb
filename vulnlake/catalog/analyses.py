"""Queries over the finished tables: joins, counts, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from vulnlake import constants as K
from vulnlake.catalog.registry import query
from vulnlake.functions import urls as U
from vulnlake.operators import candidates as C
from vulnlake.operators import links as L
from vulnlake.operators import pruning as P
from vulnlake.operators import statistics as S
from vulnlake.operators import tables as TB
from vulnlake.operators.keyed import with_position
from vulnlake.operators.products import ProductPairs
from vulnlake.operators.ranking import top_scored
from vulnlake.plans import analyses as A
from vulnlake.plans.jobs import shuffled_work
from vulnlake.views import Data

COMMIT_FREQ = """SELECT repo_url AS commit_project, sum(fixed.n * stored.n)::BIGINT AS commit_count
  FROM (SELECT repo_url, hash, count(*) AS n FROM v_fixes GROUP BY ALL) fixed
  JOIN (SELECT hash, count(*) AS n FROM v_commits GROUP BY hash) stored USING (hash) GROUP BY repo_url"""
FILE_FREQ = """SELECT fx.repo_url AS file_project, sum(ff.n * cc.n)::BIGINT AS file_count
  FROM v_fixes fx
  JOIN (SELECT hash, count(*) n FROM v_commits GROUP BY hash) cc ON fx.hash = cc.hash
  JOIN (SELECT hash, count(file_change_id) n FROM v_file_change GROUP BY hash) ff ON fx.hash = ff.hash
  GROUP BY fx.repo_url"""
METHOD_FREQ = """SELECT fx.repo_url AS method_project, sum(mm.n * cc.n)::BIGINT AS method_count
  FROM v_fixes fx
  JOIN (SELECT hash, count(*) n FROM v_commits GROUP BY hash) cc ON fx.hash = cc.hash
  JOIN (SELECT f.hash, count(m.method_change_id) n FROM v_file_change f
        JOIN v_method_change m ON m.file_change_id = f.file_change_id GROUP BY f.hash) mm ON fx.hash = mm.hash
  GROUP BY fx.repo_url"""


def project_pairs(d: Data) -> ProductPairs:
    """The pairs of ``v_cve_project`` as the two tables that they come from."""
    return ProductPairs(d("v_cpe_project"), d("v_cve_cpe"))


def _frequencies(d: Data):
    return A.frequencies(d("v_fixes"), d("v_commits"), d("v_file_change"), d("v_method_change"))


@query("job_09_commit_frequency", COMMIT_FREQ)
def _(d):
    return A.commit_frequency(d("v_fixes"), d("v_commits"))


@query("joi_07_file_frequency", FILE_FREQ)
def _(d):
    return A.file_frequency(d("v_fixes"), d("v_commits"), d("v_file_change"))


@query("joi_07_method_frequency", METHOD_FREQ)
def _(d):
    return A.method_frequency(d("v_fixes"), d("v_commits"), d("v_file_change"), d("v_method_change"))


@query("joi_06_single_line_fixes", """
    WITH small AS (SELECT hash, filename, num_lines_added, num_lines_deleted FROM v_file_change
                   WHERE greatest(num_lines_added, num_lines_deleted) <= 1),
         known AS (SELECT fx.hash, fx.cve_id, k.cwe_id FROM v_fixes fx JOIN v_cwe_classification k USING (cve_id)
                   WHERE EXISTS (SELECT 1 FROM v_cve WHERE v_cve.cve_id = fx.cve_id)),
         often AS (SELECT hash, count(*) AS n FROM v_commits GROUP BY hash)
    SELECT known.cve_id, filename, num_lines_added, num_lines_deleted, known.cwe_id
    FROM small JOIN known USING (hash) JOIN often USING (hash), generate_series(1, n)""")
def _(d):
    return A.single_line_fixes(
        d("v_file_change"), d("v_commits"), d("v_fixes"), d("v_cve"), d("v_cwe_classification")
    )


@query("joi_08_merged_frequencies", f"""
    WITH a AS ({COMMIT_FREQ}), b AS ({FILE_FREQ}), c AS ({METHOD_FREQ})
    SELECT commit_project, commit_count, file_count, method_count
    FROM a JOIN b ON commit_project = file_project JOIN c ON commit_project = method_project""")
def _(d):
    return A.merged_frequencies(*_frequencies(d))


@query("srt_02_top_projects", f"""
    WITH a AS ({COMMIT_FREQ}), b AS ({FILE_FREQ}), c AS ({METHOD_FREQ})
    SELECT split_part(commit_project, '/', -1) AS commit_project, commit_count, file_count, method_count
    FROM a JOIN b ON a.commit_project = file_project JOIN c ON a.commit_project = method_project
    ORDER BY commit_count DESC, file_count DESC, method_count DESC, 1 LIMIT 10""")
def _(d):
    return A.top_projects(A.merged_frequencies(*_frequencies(d)))


@query("joi_09_side_by_side", f"""
    WITH a AS (SELECT *, row_number() OVER (ORDER BY commit_count DESC, commit_project) AS pos FROM ({COMMIT_FREQ})),
         b AS (SELECT *, row_number() OVER (ORDER BY file_count DESC, file_project) AS pos FROM ({FILE_FREQ})),
         c AS (SELECT *, row_number() OVER (ORDER BY method_count DESC, method_project) AS pos FROM ({METHOD_FREQ}))
    SELECT pos, replace(split_part(commit_project, '/', -1), '_', '-') AS commit_project,
           replace(split_part(file_project, '/', -1), '_', '-') AS file_project,
           replace(split_part(method_project, '/', -1), '_', '-') AS method_project,
           coalesce(commit_count, 0) AS commit_count, coalesce(file_count, 0) AS file_count,
           coalesce(method_count, 0) AS method_count
    FROM a FULL JOIN b USING (pos) FULL JOIN c USING (pos)""")
def _(d):
    return A.side_by_side(*_frequencies(d))


@query("joi_10_injection_fixes_javascript", """
    WITH told AS (SELECT cve_id FROM v_cve WHERE regexp_matches(description, '(code|command) (injection|execution)', 'i')),
         meant AS (SELECT fx.hash FROM v_fixes fx LEFT JOIN told USING (cve_id)
                   LEFT JOIN (SELECT DISTINCT cve_id, true AS classed FROM v_cwe_classification WHERE cwe_id IN ('CWE-77', 'CWE-94')) k USING (cve_id)
                   WHERE classed OR told.cve_id IS NOT NULL)
    SELECT f.* FROM v_file_change f SEMI JOIN meant USING (hash)
    WHERE NOT contains(lower(new_path), 'test') AND (programming_language = 'JavaScript' OR ends_with(lower(new_path), '.js'))""")
def _(d):
    return A.javascript_injection_fixes(d("v_file_change"), d("v_fixes"), d("v_cwe_classification"), d("v_cve"))


@query("srt_07_files_by_added_lines", """
    SELECT file_change_id, num_lines_added, row_number() OVER (ORDER BY num_lines_added, file_change_id) AS pos
    FROM v_file_change""")
def _(d):
    files = d("v_file_change").select("file_change_id", "num_lines_added")
    return with_position(files, [F.col("num_lines_added"), F.col("file_change_id")])


@query("srt_01_first_ten_repositories", f"SELECT * FROM ({COMMIT_FREQ}) ORDER BY commit_count DESC, commit_project LIMIT 10")
def _(d):
    return A.commit_frequency(d("v_fixes"), d("v_commits")).orderBy(F.desc("commit_count"), "commit_project").limit(10)


@query("set_01_open_source_cves", """
    SELECT cve, url FROM (SELECT cve_id AS cve, repo_url AS url FROM v_fixes UNION ALL SELECT cve, project_url FROM v_cve_project) b
    GROUP BY cve, url""")
def _(d):
    return A.open_source_cves(d("v_fixes"), project_pairs(d))


@query("set_02_class_or_description", """
    SELECT cve_id FROM v_cwe_classification WHERE cwe_id IN ('CWE-77', 'CWE-94')
    UNION SELECT cve_id FROM v_cve WHERE description ILIKE '%injection%'""")
def _(d):
    return A.cves_of(d("v_cwe_classification"), d("v_cve"), ["CWE-77", "CWE-94"], ["injection"])


@query("set_03_link_rows", """
    SELECT cve_id, hash AS link, rel_type FROM v_fixes
    UNION ALL SELECT cve AS cve_id, project_url AS link, rel_type FROM v_cve_project""")
def _(d):
    return (
        d("v_fixes").select("cve_id", F.col("hash").alias("link"), "rel_type")
        .unionByName(d("v_cve_project").select(F.col("cve").alias("cve_id"), F.col("project_url").alias("link"), "rel_type"))
    )


@query("set_04_weaknesses_not_in_catalogue", "SELECT cwe_id FROM v_cwe_classification EXCEPT SELECT cwe_id FROM v_cwe")
def _(d):
    return d("v_cwe_classification").select("cwe_id").subtract(d("v_cwe").select("cwe_id"))


@query("joi_19_weaknesses_used_but_unknown", """
    SELECT DISTINCT cwe_id FROM v_cwe_classification c WHERE NOT EXISTS (SELECT 1 FROM v_cwe w WHERE w.cwe_id = c.cwe_id)""")
def _(d):
    return d("v_cwe_classification").select("cwe_id").distinct().join(d("v_cwe"), "cwe_id", "left_anti")


@query("set_05_distinct_classification", "SELECT DISTINCT repo_url, hash FROM v_fixes")
def _(d):
    return d("v_fixes").dropDuplicates(["repo_url", "hash"]).select("repo_url", "hash")


@query("set_06_cpe_projects_once", """
    SELECT cpe_name, repo_url, min(rel_type) AS rel_type FROM v_cpe_project GROUP BY cpe_name, repo_url""")
def _(d):
    return d("v_cpe_project").groupBy("cpe_name", "repo_url").agg(F.min("rel_type").alias("rel_type"))


@query("set_07_union_later_wins", """
    SELECT hash, arg_max(repo_url, (src, repo_url)) AS repo_url, max(src) AS src FROM (
      SELECT hash, repo_url, 1 AS src FROM v_commits UNION ALL SELECT hash, repo_url, 2 AS src FROM v_fixes)
    GROUP BY hash""")
def _(d):
    both = d("v_commits").select("hash", "repo_url", F.lit(1).alias("src")).unionByName(
        d("v_fixes").select("hash", "repo_url", F.lit(2).alias("src")))
    last = F.max(F.struct("src", "repo_url")).alias("m")
    return both.groupBy("hash").agg(last).select("hash", "m.repo_url", "m.src")


# --- joins that build the dataset -----------------------------------------------------------------


@query("joi_01_cpe_to_cve", """
    SELECT m.cve_id AS cve, p.repo_url AS project_url, min('CPE_' || p.rel_type) AS rel_type, 'False' AS checked
    FROM v_cpe_project p JOIN v_cve_cpe m ON p.cpe_name = m.cpe_name GROUP BY 1, 2""")
def _(d):
    from vulnlake.plans.jobs import map_cpe_to_cve

    return map_cpe_to_cve(d("v_cpe_project"), d("v_cve_cpe"))


@query("joi_02_cpe_without_cve", """
    SELECT DISTINCT p.cpe_name FROM v_cpe_project p LEFT JOIN v_cve_cpe m ON p.cpe_name = m.cpe_name
    WHERE m.cve_id IS NULL""")
def _(d):
    return d("v_cpe_project").select("cpe_name").distinct().join(d("v_cve_cpe"), "cpe_name", "left_anti")


@query("agg_04_missing_cves_per_cpe", """
    SELECT p.cpe_name, count(*) AS projects, count(m.cve_id) AS missing_count
    FROM v_cpe_project p LEFT JOIN v_cve_cpe m ON p.cpe_name = m.cpe_name
    WHERE m.cve_id IS NULL GROUP BY p.cpe_name""")
def _(d):
    # the CVE side is NULL on every row that is left, so its count is 0
    return (
        d("v_cpe_project").join(d("v_cve_cpe"), "cpe_name", "left_anti")
        .groupBy("cpe_name").agg(F.count("*").alias("projects")).withColumn("missing_count", F.lit(0).cast("long"))
    )


@query("joi_03_fixes_not_extracted", """
    SELECT * FROM v_fixes WHERE score >= 65 AND extraction_status = 'NOT_STARTED'
      AND hash NOT IN (SELECT DISTINCT hash FROM v_commits)""")
def _(d):
    from vulnlake.plans.jobs import pending_fixes

    return pending_fixes(d("v_fixes"), d("v_commits"))


@query("joi_04_cpe_without_project", """
    SELECT DISTINCT cpe_name FROM v_cve_cpe WHERE cpe_name NOT IN (SELECT DISTINCT cpe_name FROM v_cpe_project)""")
def _(d):
    return d("v_cve_cpe").select("cpe_name").distinct().join(d("v_cpe_project"), "cpe_name", "left_anti")


@query("joi_05_repositories_without_metadata", """
    SELECT repo_url FROM v_fixes WHERE extraction_status <> 'REPO_REMOVED' AND score >= 65
      AND repo_url NOT IN (SELECT repo_url FROM v_repository)
    UNION SELECT repo_url FROM v_repository WHERE commits_count IS NULL""")
def _(d):
    return P.missing_metadata(d("v_fixes"), d("v_repository"), K.MIN_FIX_SCORE)


@query("joi_16_pairs_already_fixed", """
    SELECT p.cve, p.project_url FROM v_cve_project p WHERE EXISTS (
      SELECT 1 FROM v_fixes f WHERE lower(f.cve_id) = lower(p.cve) AND lower(f.repo_url) = lower(p.project_url))""")
def _(d):
    from vulnlake.plans.jobs import fixed_pairs

    return fixed_pairs(project_pairs(d), d("v_fixes")).select("cve", "project_url")


@query("joi_17_commits_not_cached", """
    SELECT commit_id, repo_url FROM v_commit_log l WHERE NOT EXISTS (
      SELECT 1 FROM v_file_change f WHERE f.file_change_id = l.commit_id AND f.num_lines_added > 0)""")
def _(d):
    cached = d("v_file_change").filter("num_lines_added > 0").select(F.col("file_change_id").alias("commit_id"))
    return d("v_commit_log").select("commit_id", "repo_url").join(cached, "commit_id", "left_anti")


@query("snk_15_cached_commits", """
    SELECT f.file_change_id AS commit_id, f.num_lines_added AS hunks, l.repo_url FROM v_commit_log l JOIN v_file_change f
      ON f.file_change_id = l.commit_id WHERE f.num_lines_added > 0""")
def _(d):
    cached = d("v_file_change").filter("num_lines_added > 0").select(
        F.col("file_change_id").alias("commit_id"), F.col("num_lines_added").alias("hunks"))
    return cached.join(d("v_commit_log").select("commit_id", "repo_url"), "commit_id")


@query("joi_18_completed_fixes_without_patch", """
    SELECT DISTINCT hash, repo_url,
           replace(regexp_replace(repo_url, '^https://', ''), '/', '_') || '_' || hash || '.patch' AS patch
    FROM v_fixes f WHERE extraction_status = 'COMPLETED' AND length(hash) > 5
      AND NOT EXISTS (SELECT 1 FROM v_commits c WHERE c.repo_url = f.repo_url AND c.hash = f.hash)""")
def _(d):
    from vulnlake.plans.jobs import missing_patches

    stored = d("v_commits").select(U.patch_name(F.col("repo_url"), F.col("hash")).alias("patch"))
    return missing_patches(d("v_fixes"), stored)


@query("prj_19_patch_names", """
    SELECT hash, repo_url, replace(regexp_replace(repo_url, '^https://', ''), '/', '_') || '_' || hash || '.patch' AS patch
    FROM v_commits WHERE length(hash) > 5""")
def _(d):
    return d("v_commits").filter(F.length("hash") > 5).select(
        "hash", "repo_url", U.patch_name(F.col("repo_url"), F.col("hash")).alias("patch"))


@query("joi_25_cves_with_project", """
    SELECT cve_id FROM v_cve c WHERE EXISTS (SELECT 1 FROM v_cve_project p WHERE p.cve = c.cve_id)""")
def _(d):
    return d("v_cve").select("cve_id").join(
        project_pairs(d).cves().select(F.col("cve").alias("cve_id")), "cve_id", "left_semi")


@query("joi_23_commits_with_advisory", """
    SELECT a.cve_id, f.hash, c.repo_url FROM v_advisory a JOIN v_fixes f ON a.cve_id = f.cve_id
      JOIN v_commits c ON c.hash = f.hash AND c.repo_url = a.repo_url""")
def _(d):
    return (
        d("v_advisory").select("cve_id", "repo_url").join(d("v_fixes").select("cve_id", "hash"), "cve_id")
        .join(d("v_commits").select("hash", "repo_url"), ["hash", "repo_url"])
    )


@query("lnk_15_guessed_repositories", """
    SELECT DISTINCT cpe_name, 'https://github.com/' || replace(cpe_name, ':', '/') AS repo_url, 'GITHUB_SEARCH' AS rel_type
    FROM v_cve_cpe WHERE cpe_name NOT IN (SELECT cpe_name FROM v_cpe_project)
      AND 'https://github.com/' || replace(cpe_name, ':', '/') IN
        (SELECT 'https://github.com/' || lower(p_brand) || '/' || replace(p_name, ' ', '_') FROM part WHERE p_type = 'PROMO')""")
def _(d):
    known = d("part").filter("p_type = 'PROMO'").select(
        F.concat(F.lit("https://github.com/"), F.lower("p_brand"), F.lit("/"),
                 F.replace("p_name", F.lit(" "), F.lit("_"))).alias("repo_url"))
    missing = d("v_cve_cpe").select("cpe_name").join(d("v_cpe_project"), "cpe_name", "left_anti")
    return L.guessed_repos(missing, known)


# --- counts ------------------------------------------------------------------------------------------


@query("agg_01_fixes_per_repository", "SELECT repo_url, count(*) AS n FROM v_fixes GROUP BY repo_url")
def _(d):
    return d("v_fixes").groupBy("repo_url").agg(F.count("*").alias("n"))


@query("agg_02_projects_over_fifty", """
    SELECT project_url, count(*) AS n FROM v_cve_project GROUP BY project_url HAVING count(*) > 50""")
def _(d):
    return project_pairs(d).counts().filter(F.col("n") > K.HOT_PROJECT_ROWS)


@query("agg_03_table_counts", """
    SELECT 'commits' AS name, count(*) AS n FROM v_commits
    UNION ALL SELECT 'file_change', count(*) FROM v_file_change
    UNION ALL SELECT 'method_change', count(*) FROM v_method_change
    UNION ALL SELECT 'vulnerable_methods', count(*) FILTER (WHERE before_change) FROM v_method_change""")
def _(d):
    methods = d("v_method_change").agg(F.count("*").alias("all"), F.count_if("before_change").alias("old"))
    counts = [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        for name, df in (("commits", d("v_commits")), ("file_change", d("v_file_change")))
    ]
    both = methods.select(F.explode(F.create_map(
        F.lit("method_change"), F.col("all"), F.lit("vulnerable_methods"), F.col("old"))).alias("name", "n"))
    return counts[0].unionByName(counts[1]).unionByName(both)


@query("agg_05_links_per_cpe", """
    SELECT DISTINCT cpe_name, repo_url FROM v_cpe_project""")
def _(d):
    return d("v_cpe_project").select("cpe_name", "repo_url").distinct()


@query("agg_06_cpes_per_cve", "SELECT cve_id, count(DISTINCT cpe_name) AS n, min(cpe_name) AS first_cpe FROM v_cve_cpe GROUP BY cve_id")
def _(d):
    return d("v_cve_cpe").distinct().groupBy("cve_id").agg(
        F.count("*").alias("n"), F.min("cpe_name").alias("first_cpe"))


@query("agg_09_value_summary", """
    SELECT event_type, user_id, round(avg(value), 6) AS average, round(stddev_samp(value), 6) AS deviation,
           round(median(value), 6) AS median, count(value) AS count, round(sum(value), 6) AS sum
    FROM events GROUP BY event_type, user_id HAVING count(value) > 1""")
def _(d):
    out = S.summary(d("events"), ["event_type", "user_id"], "value")
    return out.select(
        "event_type", "user_id", *[F.round(c, 6).alias(c) for c in ("average", "deviation", "median")],
        "count", F.round("sum", 6).alias("sum"))


@query("agg_14_collected_values", "SELECT event_type, value, count(*) AS n FROM events GROUP BY event_type, value")
def _(d):
    return S.collected(d("events"), ["event_type"], "value")


@query("agg_14_unit_conflicts", """
    SELECT event_type, count(DISTINCT json_extract_string(props, '$.k')) AS units FROM events GROUP BY event_type
    HAVING count(DISTINCT json_extract_string(props, '$.k')) > 1""")
def _(d):
    rows = d("events").select("event_type", F.get_json_object("props", "$.k").alias("unit"))
    return S.unit_conflicts(rows, ["event_type"], "unit")


@query("agg_15_statistics_tree", """
    SELECT event_type AS path, count(value) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type
    UNION ALL SELECT event_type || '.' || cast(user_id AS string), count(value), round(sum(value), 4)
    FROM events GROUP BY event_type, user_id""")
def _(d):
    return S.tree(d("events"), ["event_type", "user_id"], "value").withColumn("total", F.round("total", 4))


@query("agg_16_counter_per_phase", """
    SELECT event_type AS phase, count(*) AS n, sum(cast(json_extract_string(props, '$.k') AS bigint))::BIGINT AS total
    FROM events GROUP BY event_type""")
def _(d):
    step = F.get_json_object("props", "$.k").cast("long")
    return d("events").groupBy(F.col("event_type").alias("phase")).agg(
        F.count("*").alias("n"), F.sum(step).alias("total"))


@query("agg_10_key_violations", """
    SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def _(d):
    return TB.unique_violations(d("lineitem"), ["l_orderkey", "l_linenumber"])


@query("agg_11_latest_date", "SELECT cast(max(o_orderdate) AS date) AS latest FROM orders")
def _(d):
    return d("orders").agg(F.max(F.to_date("o_orderdate")).alias("latest"))


@query("agg_18_pending_hashes_per_repository", """
    SELECT repo_url, count(DISTINCT hash) AS hashes FROM v_fixes WHERE extraction_status = 'NOT_STARTED' AND score >= 65
    GROUP BY repo_url""")
def _(d):
    from vulnlake.plans.jobs import is_pending

    pending = d("v_fixes").filter(is_pending()).select("repo_url", "hash").distinct()
    return pending.groupBy("repo_url").agg(F.count("*").alias("hashes"))


# --- windows and sorts -----------------------------------------------------------------------------------


@query("win_01_one_commit_per_hash", r"""
    SELECT hash, regexp_replace(repo_url, '\.git$', '') AS repo_url, msg FROM (
      SELECT *, row_number() OVER (PARTITION BY hash ORDER BY length(repo_url), repo_url) AS rn FROM v_commits)
    WHERE rn = 1""")
def _(d):
    return P.one_commit_per_hash(d("v_commits"))


@query("win_02_canonical_file_ids", """
    SELECT DISTINCT file_change_id, canonical_id FROM (
      SELECT file_change_id, first_value(file_change_id) OVER (
        PARTITION BY hash, old_path, new_path ORDER BY file_change_id) AS canonical_id FROM v_file_change)
    WHERE file_change_id <> canonical_id""")
def _(d):
    return P.canonical_ids(d("v_file_change"))


@query("win_03_one_file_per_key", """
    SELECT * EXCLUDE (rn) FROM (
      SELECT *, row_number() OVER (PARTITION BY hash, old_path, new_path ORDER BY file_change_id) AS rn FROM v_file_change)
    WHERE rn = 1""")
def _(d):
    files = d("v_file_change")
    return P.drop_repeated_files(files, P.canonical_ids(files))


@query("win_04_one_method_per_key", """
    WITH map AS (SELECT file_change_id AS id, min(file_change_id) OVER (PARTITION BY hash, old_path, new_path) AS canonical_id
                 FROM v_file_change),
         m AS (SELECT method_change_id, canonical_id AS file_change_id, name, signature, parameters, start_line,
                      end_line, before_change FROM v_method_change JOIN map ON id = file_change_id)
    SELECT * EXCLUDE (rn) FROM (
      SELECT *, row_number() OVER (PARTITION BY file_change_id, name, signature, parameters, start_line, end_line
                                   ORDER BY method_change_id) AS rn FROM m) WHERE rn = 1""")
def _(d):
    mapping = P.canonical_ids(d("v_file_change"))
    return P.one_method_per_key(P.repoint(d("v_method_change"), mapping))


@query("joi_20_repointed_methods", """
    WITH map AS (SELECT file_change_id AS id, min(file_change_id) OVER (PARTITION BY hash, old_path, new_path) AS canonical_id
                 FROM v_file_change)
    SELECT method_change_id, canonical_id AS file_change_id FROM v_method_change JOIN map ON id = file_change_id""")
def _(d):
    mapping = P.canonical_ids(d("v_file_change"))
    return P.repoint(d("v_method_change").select("method_change_id", "file_change_id"), mapping)


@query("win_05_first_fix_per_project", """
    SELECT cve_id, repo_url, min(hash) AS hash FROM v_fixes GROUP BY cve_id, repo_url""")
def _(d):
    from vulnlake.operators.keyed import first_per_key

    return first_per_key(d("v_fixes").select("cve_id", "repo_url", "hash"), ["cve_id", "repo_url"], [F.col("hash")])


@query("win_06_top_ten_commits", f"""
    SELECT * FROM (SELECT cve_id, repo_url, hash, score, row_number() OVER (PARTITION BY cve_id, repo_url ORDER BY score DESC, hash) AS rank
      FROM (SELECT cve_id, repo_url, hash, max(score) - 200 AS score FROM v_fixes GROUP BY 1, 2, 3)) WHERE rank <= 10 AND score > 0""")
def _(d):
    scored = d("v_fixes").groupBy("cve_id", "repo_url", "hash").agg((F.max("score") - 200).alias("score"))
    return top_scored(scored, K.REPORT_TOP)


@query("srt_03_nearest_candidates", """
    SELECT cve_id, repo_url, commit_id, position FROM (
      SELECT a.cve_id, a.repo_url, c.commit_id, row_number() OVER (PARTITION BY a.cve_id, a.repo_url
        ORDER BY abs(epoch(c.ts) - epoch(a.reserved)), c.commit_id) AS position
      FROM v_advisory a JOIN v_commit_log c ON a.repo_url = c.repo_url
        AND c.ts BETWEEN a.reserved - INTERVAL 60 DAY AND a.reserved + INTERVAL 60 DAY)
    WHERE position <= 2000""")
def _(d):
    pairs = C.nearest_within_days(d("v_advisory"), d("v_commit_log").drop("n_files"), K.MAX_CANDIDATES)
    return pairs.select("cve_id", "repo_url", "commit_id", "position")


@query("srt_05_shuffled_work", f"""
    SELECT *, md5(concat_ws('|', cve, project_url, '7')) AS draw FROM v_cve_project WHERE checked = '{K.PAIR_NOT_STARTED}'""")
def _(d):
    return shuffled_work(d("v_cve_project").filter(F.col("checked") == K.PAIR_NOT_STARTED), ["cve", "project_url"], seed=7)


@query("srt_06_sampled_commits", """
    SELECT * FROM v_commit_log
    QUALIFY row_number() OVER (PARTITION BY repo_url ORDER BY md5(commit_id || '|7'), commit_id) <= 20""")
def _(d):
    from vulnlake.plans.jobs import sample_per_repository

    return sample_per_repository(d("v_commit_log"), 20, seed=7)


@query("srt_10_tags_in_order", """
    SELECT repo_url, tag, row_number() OVER (PARTITION BY repo_url ORDER BY commit_ts, tag) AS pos FROM v_tag""")
def _(d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("repo_url").orderBy("commit_ts", "tag")
    return d("v_tag").select("repo_url", "tag", F.row_number().over(w).alias("pos"))
