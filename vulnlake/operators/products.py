"""(CVE, project) pairs through the products that both name.

The pairs are a product of two lists for every product name, so they may outnumber both tables many times over.  Nothing
here shuffles them: whether a pair was met already under another product of its CVE is seen in the row itself, and what
is asked of single pairs is looked up in the two tables.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vulnlake.session import cut_lineage

#: Most products of a project, and of a CVE, whose subsets are counted; those with more are counted by their pairs.
SUBSETS_OF_PROJECT, SUBSETS_OF_CVE = 12, 8
#: Longest list of products that a row carries; projects and CVEs with more go through an aggregation of their pairs.
MOST = 64


@dataclass(frozen=True)
class ProductPairs:
    """``projects``: ``(cpe_name, repo_url, rel_type)``, ``mapping``: ``(cve_id, cpe_name)``."""

    projects: DataFrame
    mapping: DataFrame

    def _once(self) -> DataFrame:
        named = self.projects.filter(F.col("cpe_name").isNotNull())
        return named.groupBy("cpe_name", F.col("repo_url").alias("project_url")).agg(F.min("rel_type").alias("rel_type"))

    def _links(self, most: int) -> DataFrame:
        """Links with the products before theirs in the project's order, by kind of link and name."""
        project = Window.partitionBy("project_url")
        before = project.orderBy(F.asc_nulls_last("rel_type"), "cpe_name").rowsBetween(-most, -1)
        return self._once().withColumns({
            "_before": F.collect_list("cpe_name").over(before), "_long": F.count(F.lit(1)).over(project) > most})

    def _named(self, most: int) -> DataFrame:
        """Products of every CVE, once, each with all of them; one shuffle by CVE serves all three steps."""
        cve = Window.partitionBy("cve")
        rows = self.mapping.filter(F.col("cpe_name").isNotNull()).select(F.col("cve_id").alias("cve"), "cpe_name")
        return rows.repartition("cve").distinct().withColumns({
            "_all": F.collect_list("cpe_name").over(cve.orderBy("cpe_name").rowsBetween(-most, most)),
            "_many": F.count(F.lit(1)).over(cve) > most})

    def rows(
        self, of_cve: DataFrame | None = None, of_project: DataFrame | None = None,
        per_project: Mapping[str, Column] | None = None, most: int = MOST,
    ) -> DataFrame:
        """Every pair ``(cve, project_url, rel_type)`` once, with the smallest kind of link.

        A pair stands under the first product of the CVE in the project's order, which also has the smallest kind.
        ``of_cve`` (by ``cve``), ``of_project`` (by ``project_url``) and the columns ``per_project`` are added before
        the two tables meet.
        """
        links, named = self._links(most), self._named(most)

        def with_project(rows: DataFrame) -> DataFrame:
            rows = rows if of_project is None else rows.join(of_project, "project_url", "left")
            return rows.withColumns(dict(per_project or {}))

        def with_cve(rows: DataFrame) -> DataFrame:
            return rows if of_cve is None else rows.join(of_cve, "cve", "left")

        few, short = named.filter("NOT _many").drop("_many"), links.filter("NOT _long").drop("_long")
        seen = F.arrays_overlap("_all", "_before")
        first = with_cve(few).join(with_project(short), "cpe_name").filter(~seen).drop("_all", "_before", "cpe_name")
        rest = named.filter("_many").select("cve", "cpe_name").join(links, "cpe_name").select("cve", "project_url", "rel_type")
        rest = rest.unionByName(
            few.select("cve", "cpe_name").join(links.filter("_long"), "cpe_name").select("cve", "project_url", "rel_type"))
        grouped = rest.groupBy("cve", "project_url").agg(F.min("rel_type").alias("rel_type"))
        return first.unionByName(with_cve(with_project(grouped)))

    def counts(self, of_project: int = SUBSETS_OF_PROJECT, of_cve: int = SUBSETS_OF_CVE) -> DataFrame:
        """Number of pairs of every project, ``(project_url, n)``, mostly without forming any.

        The CVEs that name any of a project's products are those that name one, less those that name two, and so on:
        CVEs are counted by each subset of their products, and a project looks up the subsets of its own.  Where a
        project has more subsets than its products have CVEs, or either side has too many products, pairs are formed.
        """
        once = self._once().select("cpe_name", "project_url")
        named = self.mapping.select(F.col("cve_id").alias("cve"), "cpe_name").distinct().join(once.select("cpe_name").distinct(), "cpe_name")
        named = named.withColumn("_many", F.count(F.lit(1)).over(Window.partitionBy("cve")) > of_cve)
        numbers = named.groupBy("cpe_name").agg(F.count(F.lit(1)).alias("_cves"))
        numbers = cut_lineage(numbers.withColumn("_id", F.monotonically_increasing_id()))
        project = Window.partitionBy("project_url")
        links = once.join(numbers, "cpe_name").withColumns({
            "_k": F.count(F.lit(1)).over(project), "_pairs": F.sum("_cves").over(project)})
        links = links.withColumn("_short", (F.col("_k") <= of_project) & (F.pow(F.lit(2), "_k") - 1 <= F.col("_pairs")))
        own = F.sort_array(F.collect_list("_id")).alias("_set")
        sets = cut_lineage(links.filter("_short").groupBy("project_url").agg(own))
        widest = sets.agg(F.max(F.size("_set"))).first()[0] or 0
        part = F.explode(F.expr(
            f"transform(filter(sequence(1, cast(pow(2, size(_set)) AS int) - 1), m -> bit_count(m) <= {widest}),"
            " m -> filter(_set, (x, i) -> (shiftright(m, i) & 1) = 1))")).alias("_part")
        lists = named.filter("NOT _many").join(numbers, "cpe_name").groupBy("cve").agg(own)
        common = lists.groupBy("_set").agg(F.count(F.lit(1)).alias("n")).select("n", part).groupBy("_part").agg(F.sum("n").alias("n"))
        sign = F.when(F.size("_part") % 2 == 1, F.col("n")).otherwise(-F.col("n"))
        found = sets.select("_set").distinct().select("_set", part).join(common, "_part").groupBy("_set").agg(F.sum(sign).alias("n"))
        parts = [sets.join(found, "_set").select("project_url", "n")]
        rest = named.select(F.col("cve").alias("cve_id"), "cpe_name", "_many")
        for which, cves in (("_short", rest.filter("_many")), ("NOT _short", rest)):
            projects = links.filter(which).select("cpe_name", F.col("project_url").alias("repo_url"), F.lit("").alias("rel_type"))
            pairs = ProductPairs(projects, cves.drop("_many")).rows()
            parts.append(pairs.groupBy("project_url").agg(F.count(F.lit(1)).alias("n")))
        return reduce(DataFrame.unionAll, parts).groupBy("project_url").agg(F.sum("n").alias("n"))

    def among(self, asked: DataFrame, fold=lambda c: c) -> DataFrame:
        """Pairs ``(cve, project_url)`` that are asked for, where ``fold`` makes names alike; no other pair is formed."""
        wanted = asked.select(fold(F.col("cve")).alias("_cve"), fold(F.col("project_url")).alias("_url")).distinct()
        named = self.mapping.filter(F.col("cpe_name").isNotNull()).select(F.col("cve_id").alias("cve"), "cpe_name").distinct()
        met = named.join(wanted, fold(F.col("cve")).eqNullSafe(F.col("_cve"))).select("cve", F.col("cpe_name").alias("_cpe"), "_url")
        same = (F.col("_cpe") == F.col("cpe_name")) & fold(F.col("project_url")).eqNullSafe(F.col("_url"))
        return met.join(self._once(), same).select("cve", "project_url").distinct()

    def cves(self) -> DataFrame:
        """CVEs with any project, repeated."""
        return self.mapping.join(self.projects, "cpe_name", "left_semi").select(F.col("cve_id").alias("cve"))
