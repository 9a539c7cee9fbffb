"""Domain views over the given tables.

The given tables hold no advisory data, so every view derives it from whole tables by fixed expressions.
The text is SQL that Spark and DuckDB both run; where the two differ a view has one text for each.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from vulnlake.plans.jobs import map_cpe_to_cve

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()

_CVE = "'CVE-' || cast(year(o_orderdate) as string) || '-' || cast(o_orderkey + 1000 as string)"
_LINE_ID = (
    "md5(cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' || cast(l_partkey as string)"
    " || '-' || cast(l_suppkey as string) || '-' || cast(cast(round(l_extendedprice * 100) as bigint) as string))"
)
_NL = "chr(10)"

VIEWS: dict[str, str | dict[str, str]] = {
    "v_repo": """
        SELECT s_suppkey AS repo_key,
               'https://github.com/org' || cast(s_nationkey as string) || '/'
                 || replace(lower(s_name), '#', '-') AS repo_url
        FROM supplier""",
    "v_repository": """
        SELECT repo_url, CASE WHEN s_acctbal < 7000 THEN cast(round(s_acctbal) as bigint) END AS commits_count
        FROM supplier JOIN v_repo ON s_suppkey = repo_key
        WHERE s_acctbal > 500""",
    "v_cve": f"""
        SELECT {_CVE} AS cve_id, o_orderkey, o_orderdate AS published, o_orderdate AS reserved,
               CASE WHEN o_orderstatus = 'F' THEN 'REJECTED' ELSE 'PUBLISHED' END AS state,
               p_name || ' ' || lower(p_type) || CASE p_brand
                 WHEN 'Brand#1' THEN ' allows Code Injection' WHEN 'Brand#2' THEN ' allows command execution'
                 WHEN 'Brand#3' THEN ' allows code execution' WHEN 'Brand#4' THEN ' allows Command Injection'
                 ELSE ' in ' || lower(p_brand) END AS description
        FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)""",
    "v_cwe": """
        SELECT 'CWE-' || cast(n_nationkey as string) AS cwe_id, n_name AS cwe_name FROM nation""",
    "v_cwe_classification": f"""
        SELECT {_CVE} AS cve_id, 'CWE-' || cast(o_custkey % 100 as string) AS cwe_id FROM orders""",
    "v_fixes": f"""
        SELECT {_CVE} AS cve_id, md5(cast(l_partkey as string)) AS hash, repo_url,
               CASE l_returnflag WHEN 'A' THEN 'NVD_DIRECT_COMMIT' WHEN 'N' THEN 'GHSD_DIRECT_COMMIT'
                 ELSE 'CPE_GIT_REPOBASED' END AS rel_type,
               CASE WHEN l_linestatus = 'O' THEN 'NOT_STARTED' ELSE 'COMPLETED' END AS extraction_status,
               cast(l_quantity as int) * 5 AS score
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN v_repo ON repo_key = l_suppkey""",
    "v_commits": """
        SELECT md5(cast(p_partkey as string)) AS hash,
               repo_url || CASE WHEN p_size % 2 = 0 THEN '.git' ELSE '' END AS repo_url, p_name AS msg
        FROM part JOIN v_repo ON repo_key = p_partkey % (SELECT count(*) FROM supplier)
        WHERE p_type <> 'PROMO'
        UNION ALL
        SELECT md5(cast(p_partkey as string)) AS hash, repo_url || '-renamed' AS repo_url, p_name AS msg
        FROM part JOIN v_repo ON repo_key = p_partkey % (SELECT count(*) FROM supplier)
        WHERE p_type <> 'PROMO' AND p_brand = 'Brand#7'""",
    "v_file_change": f"""
        SELECT {_LINE_ID} AS file_change_id, md5(cast(l_partkey as string)) AS hash,
               'f' || cast(l_suppkey % 5 as string)
                 || CASE l_returnflag WHEN 'A' THEN '.js' WHEN 'N' THEN '.py' ELSE '.c' END AS filename,
               'src/f' || cast(l_suppkey % 5 as string)
                 || CASE l_returnflag WHEN 'A' THEN '.js' WHEN 'N' THEN '.py' ELSE '.c' END AS old_path,
               CASE WHEN l_linenumber = 1 THEN 'Test/f' ELSE 'src/f' END || cast(l_suppkey % 5 as string)
                 || CASE l_returnflag WHEN 'A' THEN '.js' WHEN 'N' THEN '.py' ELSE '.c' END AS new_path,
               CASE l_returnflag WHEN 'A' THEN 'JavaScript' WHEN 'N' THEN 'Python' ELSE 'C' END
                 AS programming_language,
               '+x = Replace(/<' || cast(l_linenumber as string) || '/g, y)' AS diff,
               cast(l_quantity as int) % 6 AS num_lines_added,
               cast(round(abs(l_discount) * 100) as int) AS num_lines_deleted
        FROM lineitem""",
    "v_method_change": """
        SELECT md5(file_change_id || '-1') AS method_change_id, file_change_id, 'open' AS name, 'open(a)' AS signature,
               'a' AS parameters, 1 AS start_line, 10 AS end_line, true AS before_change
        FROM v_file_change
        UNION ALL
        SELECT md5(file_change_id || '-2') AS method_change_id, file_change_id, 'close' AS name,
               'close(a, b)' AS signature, 'a,b' AS parameters, 11 AS start_line, 20 AS end_line, false AS before_change
        FROM v_file_change""",
    "v_changed_line": {
        "spark": """
        SELECT file_change_id, cast(7 * k as int) AS line
        FROM v_file_change LATERAL VIEW explode(sequence(1, 5)) t AS k WHERE k <= num_lines_added""",
        "duckdb": """
        SELECT file_change_id, cast(7 * k as int) AS line
        FROM (SELECT file_change_id, unnest(generate_series(1, num_lines_added)) AS k FROM v_file_change)""",
    },
    "v_commit_log": f"""
        SELECT {_LINE_ID} AS commit_id, repo_url, l_shipdate AS ts, cast(l_quantity as int) * 3 AS n_files
        FROM lineitem JOIN v_repo ON repo_key = l_suppkey""",
    "v_advisory": f"""
        SELECT {_CVE} AS cve_id, repo_url, o_orderdate AS reserved
        FROM orders JOIN v_repo ON repo_key = o_custkey % (SELECT count(*) FROM supplier)""",
    "v_ref": """
        SELECT 'CVE-2024-' || cast(1000 + page_id % 50 as string) AS cve_id, page_id AS pos,
               CASE WHEN page_id % 5 = 0 THEN 'https://pypi.org/project/' || split_part(url, '/', 4)
                                              || '-' || cast(page_id as string) || '/'
                    WHEN page_id % 7 = 0 THEN 'http://github.com/' || split_part(url, '/', 3) || '/'
                                              || split_part(url, '/', 4) || '/commit/' || md5(url)
                    WHEN page_id % 11 = 0 THEN 'https://github.com/' || split_part(url, '/', 3) || '/poc-'
                                              || split_part(url, '/', 4) || '/issues/1'
                    WHEN page_id % 3 = 0 THEN 'https://www.github.com/' || split_part(url, '/', 3) || '/'
                                              || split_part(url, '/', 4) || '/issues/' || cast(page_id as string)
                    WHEN page_id % 13 = 0 THEN 'https://github.com/' || split_part(url, '/', 3) || '/'
                                              || split_part(url, '/', 4) || '/pull/' || cast(page_id as string) || '?x=1'
                    ELSE url END AS url
        FROM pages""",
    "v_package_links": """
        SELECT CASE page_id % 6 WHEN 0 THEN 'PYPI' WHEN 1 THEN 'NPM' WHEN 2 THEN 'GO' WHEN 3 THEN 'RUBYGEMS'
                 WHEN 4 THEN 'COMPOSER' ELSE 'PYPI' END AS ecosystem,
               split_part(url, '/', 4) || '-' || cast(page_id - page_id % 6 as string) AS name,
               '1.' || cast(page_id as string) AS version,
               CASE WHEN page_id % 4 < 2 THEN 'SOURCE_REPO' ELSE 'HOMEPAGE' END AS label,
               'git+https://github.com/' || split_part(url, '/', 3) || '/' || split_part(url, '/', 4)
                 || '-' || cast(page_id as string) || '.git' AS url
        FROM pages""",
    "v_package_release": """
        SELECT CASE page_id % 5 WHEN 0 THEN 'PYPI' WHEN 1 THEN 'NPM' WHEN 2 THEN 'PYPI' WHEN 3 THEN 'RUBYGEMS' ELSE 'NPM' END AS ecosystem,
               split_part(url, '/', 3) AS name, (page_id * 37) % 1009 AS pos, '1.' || cast(page_id as string) AS version, label,
               'git+https://github.com/' || split_part(url, '/', 3) || '/' || label || '-' || cast(page_id as string) || '.git' AS url,
               timestamp '2024-01-01 00:00:00' AS published
        FROM pages CROSS JOIN (SELECT 'SOURCE_REPO' AS label UNION ALL SELECT 'HOMEPAGE' AS label) l
        WHERE label = 'HOMEPAGE' OR page_id % 3 > 0""",
    "v_registry_url": """
        SELECT page_id, CASE page_id % 9
                 WHEN 0 THEN 'https://www.npmjs.com/package/@' || split_part(url, '/', 4) || '/p' || cast(page_id as string)
                 WHEN 1 THEN 'https://pkg.go.dev/' || split_part(url, '/', 3) || '/m@v1.' || cast(page_id as string) || '?tab=doc'
                 WHEN 2 THEN 'https://rubygems.org/gems/' || split_part(url, '/', 4) || '/versions'
                 WHEN 3 THEN 'https://packagist.org/packages/' || split_part(url, '/', 4) || '/p' || cast(page_id as string)
                 WHEN 4 THEN 'https://pypi.org/project/' || split_part(url, '/', 4) || '/#files'
                 WHEN 5 THEN 'https://crates.io/crates/' || split_part(url, '/', 4) || '_x/'
                 WHEN 6 THEN 'https://www.nuget.org/packages/' || split_part(url, '/', 4) || '.Core/'
                 WHEN 7 THEN 'https://repo1.maven.org/maven2/' || split_part(url, '/', 4)
                 ELSE url END AS url
        FROM pages""",
    "v_git_url": """
        SELECT page_id, CASE page_id % 6
                 WHEN 0 THEN 'git+https://git@' || split_part(url, '/', 3) || '/a/b.git'
                 WHEN 1 THEN 'git://' || split_part(url, '/', 3) || '/a/b.git'
                 WHEN 2 THEN 'ssh://git@github.com/' || split_part(url, '/', 3) || '/b'
                 WHEN 3 THEN 'https://github.com/' || split_part(url, '/', 3) || '/b/tree/main'
                 WHEN 4 THEN 'https://github.com/' || split_part(url, '/', 3) || '/' || cast(page_id as string) || '.git'
                 ELSE url END AS url
        FROM pages""",
    "v_url_status": """
        SELECT url, page_id,
               CASE page_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 429 ELSE 302 END AS status,
               CASE WHEN page_id % 8 = 3 THEN 'https://gitlab.com/users/sign_in'
                    WHEN page_id % 4 = 3 THEN url || 'x' END AS location
        FROM pages""",
    "v_message": """
        SELECT md5(cast(doc_id as string)) AS commit_id,
               CASE WHEN length(source) > 4 THEN 'https://github.com/apache/' ELSE 'https://github.com/acme/' END
                 || source AS repository,
               doc_id, source, timestamp '2024-01-01 00:00:00' AS base_ts,
               text || CASE WHEN doc_id % 11 = 0 THEN ' fixes CVE-2024-' || cast(1000 + doc_id % 40 as string)
                                 || CASE WHEN doc_id % 2 = 0 THEN ' and CVE-2024-99999' ELSE '' END ELSE '' END
                    || CASE WHEN doc_id % 13 = 0 THEN ' see #' || cast(doc_id % 50 as string) ELSE '' END
                    || CASE WHEN doc_id % 17 = 0 THEN ' Security XSS fix' ELSE '' END
                    || CASE WHEN doc_id % 19 = 0 THEN ' closes AMQ-' || cast(doc_id % 60 as string) ELSE '' END
                    || CASE WHEN doc_id % 23 = 0 THEN ' as in /commit/' || md5(text) ELSE '' END AS message
        FROM documents""",
    "v_linked_issue": {
        "spark": """
        SELECT cast(conv_id as string) AS issue_id,
               array_join(transform(array_sort(collect_list(struct(turn, text))), s -> s.text), ' ')
                 || CASE WHEN conv_id % 5 = 0 THEN ' CVE-2024-' || cast(1000 + conv_id % 40 as string)
                         WHEN conv_id % 7 = 0 THEN ' remote attack' ELSE '' END AS content
        FROM conversations GROUP BY conv_id""",
        "duckdb": """
        SELECT cast(conv_id as string) AS issue_id,
               string_agg(text, ' ' ORDER BY turn, text)
                 || CASE WHEN conv_id % 5 = 0 THEN ' CVE-2024-' || cast(1000 + conv_id % 40 as string)
                         WHEN conv_id % 7 = 0 THEN ' remote attack' ELSE '' END AS content
        FROM conversations GROUP BY conv_id""",
    },
    "v_diff": f"""
        SELECT doc_id, '@@ -1,9 +1,9 @@' || {_NL} || replace(replace(replace(replace(replace(text,
                 {_NL} || 'T', {_NL} || '+T'), {_NL} || 'E', {_NL} || '-E'),
                 {_NL} || 'O', {_NL} || '+++ b/O'), {_NL} || 'A', {_NL} || '-A'),
                 {_NL} || 'I', {_NL} || '@@ -40,9 +50,9 @@' || {_NL} || '+I') AS diff
        FROM documents""",
    "v_cpe_project": """
        SELECT lower(p_brand) || ':' || replace(p_name, ' ', '_') AS cpe_name, repo_url,
               'GIT_REPOBASED' AS rel_type
        FROM part JOIN v_repo ON repo_key = p_partkey % (SELECT count(*) FROM supplier)
        WHERE p_type <> 'PROMO' AND p_size > 25""",
    "v_cve_cpe": f"""
        SELECT {_CVE} AS cve_id, lower(p_brand) || ':' || replace(p_name, ' ', '_') AS cpe_name
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
        WHERE p_size < 40""",
    "v_cve_project": """
        SELECT cve, project_url, min(rel_type) AS rel_type, 'False' AS checked
        FROM (SELECT cve_id AS cve, repo_url AS project_url, 'CPE_' || rel_type AS rel_type
              FROM v_cpe_project JOIN v_cve_cpe USING (cpe_name))
        GROUP BY cve, project_url""",
    "v_tag": """
        SELECT repo_url, 'v' || cast(l_suppkey as string) || '.'
                 || CASE l_returnflag WHEN 'A' THEN '1' WHEN 'N' THEN '2-rc1' ELSE '3_0' END AS tag,
               min(l_shipdate) AS author_ts, max(l_shipdate) AS commit_ts
        FROM lineitem JOIN v_repo ON repo_key = l_suppkey
        GROUP BY repo_url, l_suppkey, l_returnflag""",
    "v_advisory_text": """
        SELECT item_id, 'CVE-2024-' || cast(1000 + item_id as string) AS cve_id,
               CASE WHEN item_id % 20 > 9 THEN 'https://github.com/apache/' ELSE 'https://github.com/acme/' END
                 || 'src' || cast(item_id % 20 as string) AS repository, text AS description
        FROM benchmark""",
}


def _names(sql: str) -> set[str]:
    return set(re.findall(r"\b[a-z_]+\b", sql))


def _text(name: str, engine: str) -> str:
    body = VIEWS[name]
    return body if isinstance(body, str) else body[engine]


def _needed(sql: str, engine: str) -> list[str]:
    """Views used by ``sql``, directly or through other views, in an order that can be built."""
    used: list[str] = []

    def visit(text: str) -> None:
        words = _names(text)
        for name in VIEWS:
            if name in words and name not in used:
                visit(_text(name, engine))
                if name not in used:
                    used.append(name)

    visit(sql)
    return used


def oracle(sql: str) -> str:
    """``sql`` for DuckDB with the definitions of the views it uses in front."""
    sql = sql.strip()
    parts = [f"{name} AS ({_text(name, 'duckdb').strip()})" for name in _needed(sql, "duckdb")]
    if not parts:
        return sql
    if re.match(r"(?i)with\b", sql):
        recursive = re.match(r"(?i)with\s+recursive\b", sql)
        sql = re.sub(r"(?i)^with(\s+recursive)?", "", sql, count=1).strip()
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + ",\n" + sql
    return "WITH " + ",\n".join(parts) + "\n" + sql


class Data:
    """The given tables and the domain views of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        if name == "v_cve_project":  # by the operator, which does not shuffle its pairs
            return map_cpe_to_cve(self("v_cpe_project"), self("v_cve_cpe"))
        return self.sql(f"SELECT * FROM {name}")

    def __call__(self, name: str) -> DataFrame:
        return self.table(name) if name in TABLES else self.view(name)

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the tables and views by name."""
        needed = _needed(text, "spark")
        words = set().union(_names(text), *[_names(_text(n, "spark")) for n in needed])
        for name in TABLES:
            if name in words:
                self.table(name).createOrReplaceTempView(name)
        for name in needed:
            self.spark.sql(self._with_counts(_text(name, "spark"))).createOrReplaceTempView(name)
        return self.spark.sql(text)

    def _with_counts(self, text: str) -> str:
        """Row counts come from the file footers; as literals they keep joins free of subqueries."""
        return re.sub(
            r"\(SELECT count\(\*\) FROM (\w+)\)", lambda m: str(self.table(m.group(1)).count()), text
        )
