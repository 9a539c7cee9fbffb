"""Vulnerability feeds that have landed as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnlake import constants as K
from vulnlake import schema as S
from vulnlake.operators.keyed import first_per_key
from vulnlake.functions.urls import cpe_product
from vulnlake.sources.exports import year_of

METRICS = {
    "cvss2": (S.CVSS2_FIELDS, ["cvssMetricV2"]),
    "cvss3": (S.CVSS3_FIELDS, ["cvssMetricV31", "cvssMetricV30"]),
    "cvss4": (S.CVSS4_FIELDS, ["cvssMetricV40"]),
}


def read_nvd(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Records of the yearly feeds; a zipped year is one task to read, so the records are spread afterwards."""
    rows = (
        spark.read.schema(S.NVD).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
        .select(F.explode("vulnerabilities").alias("v")).select("v.*")
    )
    return rows.repartition(partitions) if partitions else rows.repartition("cve.id")


def _first(metrics: list[str]) -> list[Column]:
    return [F.get(F.col(f"cve.metrics.{m}"), F.lit(0)) for m in metrics]


def flatten_cve(records: DataFrame) -> DataFrame:
    """One flat row per record; the newer score version wins field by field, its two scores even when missing."""
    columns = [
        F.col("cve.id").alias("cve_id"),
        F.try_to_timestamp(F.col("cve.published")).alias("published_date"),
        F.try_to_timestamp(F.col("cve.lastModified")).alias("last_modified_date"),
        F.get(F.col("cve.descriptions"), F.lit(0))["value"].alias("description"),
    ]
    for prefix, (fields, metrics) in METRICS.items():
        entries = _first(metrics)
        columns += [
            F.coalesce(*[e["cvssData"][source] for e in entries]).alias(f"{prefix}_{name}")
            for source, name in fields.items()
        ]
        newest = F.coalesce(*entries)
        columns += [
            newest["exploitabilityScore"].alias(f"{prefix}_exploitability_score"),
            newest["impactScore"].alias(f"{prefix}_impact_score"),
        ]
    configurations = F.coalesce(F.col("cve.configurations"), F.col("configurations"))
    for value, name in (
        (F.col("cve.references"), "reference_json"), (F.col("cve.weaknesses"), "weakness_json"),
        (configurations, "configurations_json"),
    ):
        columns.append(F.when(F.size(value) > 0, F.to_json(value)).alias(name))
    return records.select(*columns)


def references(cve: DataFrame) -> DataFrame:
    """Reference urls in order ``(cve_id, pos, url)``."""
    return cve.select(
        "cve_id", F.posexplode(F.from_json("reference_json", S.REFERENCES)).alias("pos", "r")
    ).select("cve_id", "pos", F.col("r.url").alias("url"))


def weaknesses(cve: DataFrame) -> DataFrame:
    """Weakness ids of a CVE, once each; ``NVD-CWE-noinfo`` when there is none."""
    values = F.flatten(F.transform(
        F.from_json("weakness_json", S.WEAKNESSES),
        lambda w: F.transform(F.coalesce(w["description"], F.array().cast(S.TEXTS)), lambda t: t["value"]),
    ))
    named = F.filter(values, lambda v: v.isNotNull() & (v != ""))
    ids = F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("NVD-CWE-noinfo")))
    return cve.select("cve_id", F.explode(ids).alias("cwe_id")).distinct()


def cpe_names(cve: DataFrame, all_nodes: bool = False) -> DataFrame:
    """Vulnerable products of a CVE ``(cve_id, cpe_name)`` from the first node of each configuration."""
    none = F.array().cast(S.listed(S.MATCH))
    nodes = "config.nodes" if all_nodes else F.slice("config.nodes", 1, 1)
    rows = (
        cve.select("cve_id", F.explode(F.from_json("configurations_json", S.CONFIGURATIONS)).alias("config"))
        .select("cve_id", F.explode(nodes).alias("node"))
        .select(
            "cve_id",
            F.explode(F.concat(
                F.coalesce("node.cpeMatch", none),
                F.coalesce(F.flatten(F.transform("node.children", lambda c: F.coalesce(c["cpeMatch"], none))), none),
            )).alias("m"),
        )
    )
    return rows.filter(F.col("m.vulnerable") & (F.col("m.criteria") != "")).select(
        "cve_id", cpe_product(F.col("m.criteria")).alias("cpe_name")
    ).distinct()


def read_cwe(spark: SparkSession, path: str) -> DataFrame:
    """Weaknesses and categories of the XML catalogue and three rows it lacks; the first of an id wins."""
    def nodes(tag: str, category: bool, schema: str, short: str, long: Column) -> DataFrame:
        raw = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
        return raw.select(
            F.concat(F.lit("CWE-"), "_ID").alias("cwe_id"), F.col("_Name").alias("cwe_name"),
            F.col(short).alias("description"), long.alias("extended_description"),
            F.concat(F.lit("https://cwe.mitre.org/data/definitions/"), "_ID", F.lit(".html")).alias("url"),
            F.lit(category).alias("is_category"),
        )

    plain = F.trim(F.regexp_replace("Extended_Description", "<[^>]*>", ""))
    weakness = nodes("Weakness", False, "_ID string, _Name string, Description string, Extended_Description string", "Description", plain)
    category = nodes("Category", True, "_ID string, _Name string, Summary string", "Summary", F.lit(""))
    extra = spark.createDataFrame(
        K.EXTRA_WEAKNESSES, "cwe_id string, cwe_name string, description string, extended_description string, url string, is_category boolean")
    parts = [part.withColumn("_order", F.lit(i)) for i, part in enumerate((weakness, category, extra))]
    return first_per_key(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["cwe_id"], [F.col("_order")]).drop("_order")


def read_cpe(spark: SparkSession, path: str) -> DataFrame:
    """Links of every product of the dictionary ``(cpe_name, pos, url)``, once each, at their first place in a list."""
    rows = spark.read.schema(S.CPE_DICTIONARY).option("multiLine", True).json(path)
    names = rows.select(F.explode("products.cpe").alias("c")).filter(F.col("c.cpeName") != "")
    links = names.select(cpe_product(F.col("c.cpeName")).alias("cpe_name"), F.posexplode("c.refs.ref").alias("pos", "url"))
    first = links.filter(F.col("url").isNotNull()).groupBy("cpe_name", "url").agg(F.min("pos").alias("pos"))
    return first.select("cpe_name", "url", "pos")


def read_advisories(spark: SparkSession, path: str) -> DataFrame:
    """Advisories, one file each, in any folder below ``path``; the folder names the ecosystem of a dump."""
    rows = (
        spark.read.schema(S.ADVISORY).option("multiLine", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json").json(path)
    )
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    cves = F.filter(
        F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array(F.coalesce("id", F.lit("")))),
        lambda x: F.upper(x).startswith("CVE-"),
    )
    return rows.withColumn("folder", folder).withColumn("cve_ids", cves).filter(F.size("cve_ids") > 0)


def advisory_refs(advisories: DataFrame) -> DataFrame:
    return advisories.select(F.col("id").alias("advisory_id"), F.posexplode("references.url").alias("pos", "url")).filter(
        F.col("url").isNotNull())


def advisory_packages(advisories: DataFrame) -> DataFrame:
    return advisories.select(F.col("id").alias("advisory_id"), F.posexplode("affected.package").alias("pos", "p")).select(
        "advisory_id", "pos", F.col("p.ecosystem").alias("ecosystem"), F.col("p.name").alias("name"))


def read_cve_records(spark: SparkSession, path: str) -> DataFrame:
    """Published records of the CVE list."""
    rows = spark.read.schema(S.CVE_RECORD).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    cna = F.col("containers.cna")
    meta = F.col("cveMetadata")
    seconds = {n: F.unix_timestamp(F.try_to_timestamp(meta[f"date{n}"])) for n in ("Reserved", "Published", "Updated")}
    return rows.filter(meta["state"] != "REJECTED").select(
        meta["cveId"].alias("cve_id"),
        *[v.alias(f"{n.lower()}_timestamp") for n, v in seconds.items()],
        F.get(cna["descriptions"], F.lit(0))["value"].alias("description"),
        F.get(cna["affected"], F.lit(0))["product"].alias("product"),
        F.get(F.get(cna["affected"], F.lit(0))["versions"], F.lit(0)).alias("versions"),
        cna["references"]["url"].alias("urls"),
    )


def read_years(spark: SparkSession, path: str, schema: T.StructType, years: Sequence[int | None] | None = None) -> DataFrame:
    """Records written by year; only the folders of the asked years are opened (None: ids without a year)."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("year", T.IntegerType())])).json(path)
    if years is None:
        return rows
    known = F.col("year").isin(sorted(y for y in years if y is not None))
    return rows.filter(known | F.col("year").isNull() if None in years else known)


def records_of(spark: SparkSession, path: str, schema: T.StructType, asked: DataFrame) -> DataFrame:
    """Records of the asked ids ``(cve_id)``; the years they name, a few dozen, decide which folders are opened."""
    ids = asked.select("cve_id").filter("cve_id IS NOT NULL").distinct()
    years = [r.year for r in ids.select(year_of(F.col("cve_id")).alias("year")).distinct().collect()]
    return read_years(spark, path, schema, years).drop("year").join(ids, "cve_id", "left_semi")
