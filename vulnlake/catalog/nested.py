"""Queries over feed records that Spark builds from whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vulnlake.catalog.registry import query
from vulnlake.functions import versions as V
from vulnlake.sources import feeds

MATCH = "struct<vulnerable:boolean,criteria:string,versionStartIncluding:string,versionEndExcluding:string>"


def records(d):
    """A feed record per order: lines as references, customer as weakness, parts as configurations."""
    line = d("lineitem").join(d("part").select("p_partkey", "p_brand", "p_size"), F.col("p_partkey") == F.col("l_partkey"))
    nested = line.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "p_brand", "p_size"))).alias("lines"))
    orders = d("orders").join(nested, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    refs = F.transform("lines", lambda x: F.struct(F.concat(
        F.lit("https://example.org/"), x["l_partkey"].cast("string"), F.lit("/"), x["l_linenumber"].cast("string")).alias("url")))
    weak = F.when(F.col("o_orderstatus") != "P", F.array(F.struct(F.array(F.struct(
        F.concat(F.lit("CWE-"), (F.col("o_custkey") % 40).cast("string")).alias("value"))).alias("description"))))
    matches = F.transform("lines", lambda x: F.struct(
        (x["p_size"] > 10).alias("vulnerable"),
        F.concat(F.lit("cpe:2.3:a:"), F.lower(x["p_brand"]), F.lit(":p"), x["l_suppkey"].cast("string"), F.lit(":*")).alias("criteria"),
        F.concat(x["p_size"].cast("string"), F.lit(".0")).alias("versionStartIncluding"),
        F.concat((x["p_size"] + 1).cast("string"), F.lit(".0")).alias("versionEndExcluding")))
    config = F.array(F.struct(F.array(F.struct(matches.alias("cpeMatch"))).alias("nodes")))
    return orders.select(
        F.concat(F.lit("CVE-"), F.col("o_orderkey").cast("string")).alias("cve_id"),
        F.to_json(refs).alias("reference_json"), F.to_json(weak).alias("weakness_json"),
        F.when(F.col("lines").isNotNull(), F.to_json(config)).alias("configurations_json"))


CVE = "'CVE-' || cast(o_orderkey AS string)"


@query("exp_01_reference_urls", """
    SELECT 'CVE-' || cast(l_orderkey AS string) AS cve_id,
           'https://example.org/' || cast(l_partkey AS string) || '/' || cast(l_linenumber AS string) AS url FROM lineitem""")
def _(d):
    return feeds.references(records(d)).select("cve_id", "url")


@query("exp_02_weaknesses", f"""
    SELECT {CVE} AS cve_id, CASE WHEN o_orderstatus = 'P' THEN 'NVD-CWE-noinfo' ELSE 'CWE-' || cast(o_custkey % 40 AS string) END AS cwe_id
    FROM orders""")
def _(d):
    return feeds.weaknesses(records(d))


@query("exp_03_cpe_names", f"""
    SELECT DISTINCT 'CVE-' || cast(l_orderkey AS string) AS cve_id, lower(p_brand) || ':p' || cast(l_suppkey AS string) AS cpe_name
    FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 10""")
def _(d):
    return feeds.cpe_names(records(d))


@query("exp_05_version_ranges", """
    SELECT 'CVE-' || cast(l_orderkey AS string) AS cve_id,
           '[' || cast(p_size AS string) || '.0:' || cast(p_size + 1 AS string) || '.0)' AS version_range
    FROM lineitem JOIN part ON p_partkey = l_partkey""")
def _(d):
    from vulnlake import schema as S

    ranges = V.cpe_ranges(F.from_json("configurations_json", S.CONFIGURATIONS))
    return records(d).select("cve_id", F.explode(ranges).alias("version_range"))


@query("exp_06_fixed_versions", """
    SELECT 'CVE-' || cast(l_orderkey AS string) AS cve_id, cast(p_size + 1 AS string) || '.0' AS fixed
    FROM lineitem JOIN part ON p_partkey = l_partkey""")
def _(d):
    from vulnlake import schema as S

    parsed = records(d).withColumn("c", F.from_json("configurations_json", S.CONFIGURATIONS))
    return parsed.select("cve_id", F.explode(V.node_versions(F.col("c"))[1]).alias("fixed"))


@query("exp_04_alias_rows", """
    SELECT cve, rel_type FROM (SELECT unnest(['CVE-A-' || cast(o_orderkey AS string), 'cve-B-' || cast(o_custkey AS string)]) AS cve,
      CASE WHEN o_orderstatus = 'O' THEN 'GHSD_DIRECT_COMMIT' ELSE 'GHSD_GIT_REPOBASED' END AS rel_type FROM orders)""")
def _(d):
    aliases = F.array(F.concat(F.lit("CVE-A-"), F.col("o_orderkey").cast("string")), F.lit("GHSA-x"),
                      F.concat(F.lit("cve-B-"), F.col("o_custkey").cast("string")))
    cves = F.filter(aliases, lambda x: F.upper(x).startswith("CVE-"))
    kind = F.when(F.col("o_orderstatus") == "O", "GHSD_DIRECT_COMMIT").otherwise("GHSD_GIT_REPOBASED")
    return d("orders").select(F.explode(cves).alias("cve"), kind.alias("rel_type"))
