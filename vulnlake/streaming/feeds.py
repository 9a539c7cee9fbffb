"""Incremental feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vulnlake import schema as S
from vulnlake.operators.store import Store, Transaction
from vulnlake.sources.feeds import flatten_cve


def modified_within(records: DataFrame, column: str, as_of: str, days: int) -> DataFrame:
    """Records modified in the ``days`` before ``as_of``."""
    end = F.to_timestamp(F.lit(as_of))
    return records.filter((F.col(column) >= end - F.make_dt_interval(F.lit(days))) & (F.col(column) <= end))


def newest_first(modified: str) -> list[Column]:
    """Order that puts the record modified last in front; records without a date come after all others."""
    return [-F.unix_micros(F.col(modified).try_cast("timestamp"))]


def follow_feed(
    spark: SparkSession, landing: str, schema: T.StructType, root: str, table: str, checkpoint: str,
    keys: Sequence[str], modified: str, buckets: int = 64,
) -> StreamingQuery:
    """Read the feed files (JSON lines) that are new since the last run and replace the changed records.

    Of a record's versions the one modified last counts, whether it came in this batch or before, and one without a
    date only where there is no other.  The checkpoint remembers which files were read.  A batch rewrites the buckets
    its records fall into and no others; one that is run again replaces the same rows once more, so the table does
    not change.
    """
    stream = spark.readStream.schema(schema).json(landing)

    def apply(batch: DataFrame, _: int) -> None:
        Store(batch.sparkSession, root).upsert(table, batch, keys, newest_first(modified), buckets)

    return (
        stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def follow_nvd(
    spark: SparkSession, landing: str, root: str, checkpoint: str, table: str = "cve", files: str = "feed_files",
    buckets: int = 64, per_batch: int = 64,
) -> StreamingQuery:
    """Follow nested feed files (plain or zipped), at most ``per_batch`` at once.

    A file counts once by its content: its checksum is kept beside the records, and a file whose checksum is known,
    under whatever name it lands again, is not parsed.  Records and checksums become current together, so a batch that
    died is either wholly there or read again.  Files that are not valid JSON leave no checksum.
    """
    stream = (
        spark.readStream.option("maxFilesPerTrigger", per_batch).text(landing, wholetext=True)
        .select(F.col("_metadata.file_path").alias("file"), F.sha2("value", 256).alias("sha256"), "value")
    )

    def change(work: Transaction, batch: DataFrame) -> None:
        fresh = batch.dropDuplicates(["sha256"])
        if work.exists(files):
            fresh = fresh.join(work.read(files).select("sha256"), "sha256", "left_anti")
        parsed = fresh.withColumn("feed", F.from_json("value", S.NVD)).filter("feed.vulnerabilities IS NOT NULL").drop("value").persist()
        try:
            names = parsed.select("file", "sha256")
            if names.isEmpty():
                return
            records = flatten_cve(parsed.select(F.explode("feed.vulnerabilities").alias("v")).select("v.*")).filter("cve_id IS NOT NULL")
            work.upsert(table, records, ["cve_id"], newest_first("last_modified_date"), buckets)
            work.append(files, names)
        finally:
            parsed.unpersist()

    def apply(batch: DataFrame, _: int) -> None:
        Store(batch.sparkSession, root).retry(lambda work: change(work, batch))

    return (
        stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def reset_interrupted(pairs: DataFrame) -> DataFrame:
    """Pairs whose work was cut short go back to the start."""
    from vulnlake import constants as K

    cut = F.col("checked").isin(K.PAIR_FINDING_FIX, K.PAIR_REPO_UNAVAILABLE)
    return pairs.withColumn("checked", F.when(cut, K.PAIR_NOT_STARTED).otherwise(F.col("checked")))
