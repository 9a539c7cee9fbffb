"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, whatever their names."""
    return F.struct(*[F.col(quoted(c)) for c in docs.columns])


def plain_names(docs: DataFrame) -> DataFrame:
    """The same columns named c0, c1, ..; names with dots cannot be handed to Python workers."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def n_words(text: Column) -> Column:
    """Number of words of ``WORD``; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def texts_of(column: pa.Array) -> list[str]:
    """Texts of an Arrow column, null as empty."""
    return [x if x is not None else "" for x in column.to_pylist()]


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string column, null as empty, and where each row starts (one more at the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    whole = column.buffers()[2]
    if whole is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(whole, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def give_back() -> None:
    """Hand memory that is free back to the system, which Python workers would keep between batches."""
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass


def pieces(batches: Iterable[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``limit`` bytes of text, or one row."""
    for batch in batches:
        at, n = 0, batch.num_rows
        if not n:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = column.cast(pa.large_binary()).fill_null(b"")
        ends = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset + 1 : sizes.offset + n + 1]
        first = int(np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset])
        while at < n:
            begin = first if not at else int(ends[at - 1])
            to = max(at + 1, int(np.searchsorted(ends, begin + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
        give_back()


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def place_tags(ids: pa.Array, start: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit number for each (document, start), null ids apart; it tells places apart in little room."""
    known = ids.cast(pa.int64()).fill_null(-(1 << 62)).to_numpy(zero_copy_only=False).view(np.uint64)
    with np.errstate(over="ignore"):
        tag = mixed(known + np.uint64(0x3C6EF372FE94F82B))
        if more is not None:
            tag = mixed(tag ^ more.view(np.uint64))
        return mixed(tag + start.astype(np.uint64)).view(np.int64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n - 1 modulo 2 ** 64."""
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, np.uint64(base)
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * step
        done += more
        with np.errstate(over="ignore"):
            step = step * step
    return out[:n]


_ROLL = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_ROLL, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = _POWERS[base] = powers(base, max(n, 1 << 16))
    return have


class RangeHash:
    """64-bit hashes of any byte ranges of one buffer, each in constant time.

    Bytes become random 64-bit numbers; a range hashes to their polynomial, scattered at the end.
    """

    def __init__(self, data: np.ndarray, seed: int) -> None:
        numbers = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)
        with np.errstate(over="ignore"):
            sums = np.cumsum(numbers[data] * _power(_ROLL, len(data))[: len(data)], dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), sums])
        self.back = _power(_BACK, len(data) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def word_bounds(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word (a run without ASCII white space); no word crosses rows."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    space = (data == 32) | ((data >= 9) & (data <= 13))
    first = np.zeros(len(data) + 1, bool)
    first[rows] = True
    inside = ~space
    before = np.concatenate([[False], inside[:-1]]) & ~first[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~first[1:]
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(rows, start, "right") - 1


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_hashes(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shingles of ``width`` words of every row, A-Z lower-cased, in text order.

    Returns hash, row and first word (counted in its row) of each shingle, then words and shingles per row.
    A row of fewer words, but at least one, has its whole sequence as the only shingle.
    """
    data, rows = buffer_of(column)
    n = len(rows) - 1
    start, end, row = word_bounds(data, rows)
    words = np.bincount(row, minlength=n).astype(np.int64) if len(row) else np.zeros(n, np.int64)
    if not len(start):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, words, np.zeros(n, np.int64)
    hashes = RangeHash(_LOWER[data], 7)(start, end)
    first_of = np.concatenate([[0], np.cumsum(words)])
    count = np.where(words >= width, words - width + 1, (words > 0).astype(np.int64))
    of = np.repeat(np.arange(n), count)
    at = np.arange(len(of)) - np.repeat(np.concatenate([[0], np.cumsum(count)])[:-1], count)
    begin = first_of[of] + at
    out = np.zeros(len(of), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            here = j < words[of]
            picked = hashes[np.minimum(begin + j, len(hashes) - 1)]
            out = np.where(here, mixed(out * np.uint64(0x2545F4914F6CDD1D) + picked), out)
    return out, of, at, words, count


def forget(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints of steps that nothing refers to any more.

    It does so when the driver collects its garbage, which a driver with little to do may not do for half an hour; a job
    of many rounds would keep the files of all of them.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def connected(spark: SparkSession, links: DataFrame, most: int = 60) -> DataFrame:
    """Smallest member of every connected component: rows (node, component) of the nodes in ``links`` (a, b).

    Alternates large-star and small-star steps until no link changes; each round is two aggregations, and
    a hot centre is only ever the value of a ``min``.  Rounds grow with the logarithm of the longest chain.
    """
    edges = cut_lineage(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    for _ in range(most):
        # large star: larger neighbours of u meet the smallest one around u
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # small star: smaller neighbours of u, and u, meet the smallest one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        edges = cut_lineage(small.filter("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
        del both, least, large, low, small
        forget(spark)
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")


def hash_buckets(docs: DataFrame) -> int:
    """Buckets for about a hash a byte of text, so that each holds at most some million hashes."""
    n = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(8, n >> 23)


PACKED = "bucket long, data binary"


def packed_hashes(hashes: Iterable[np.ndarray], buckets: int, held: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """64-bit hashes four bytes each, many to a row, by bucket; of equal ones that meet here two are enough."""
    def rows(found: list[np.ndarray]) -> pa.RecordBatch:
        bits = np.concatenate(found).view(np.uint64)
        short = np.sort(((bits >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (bits & np.uint64(0xFFFFFFFF)))
        short = short[np.concatenate([np.ones(min(2, len(short)), bool), short[2:] != short[:-2]])]
        bucket, first = np.unique(short >> np.uint64(32), return_index=True)
        low = (short & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        data = [part.tobytes() for part in np.split(low, first[1:])]
        return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), pa.array(data, pa.binary())], ["bucket", "data"])

    found, n = [], 0
    for some in hashes:
        found.append(some)
        n += len(some)
        if n >= held:
            yield rows(found)
            found, n = [], 0
            give_back()
    if n:
        yield rows(found)
    found.clear()
    give_back()


def _twice(table: pa.Table) -> pa.Table:
    low = np.sort(np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("data").to_pylist()]))
    same = low[1:] == low[:-1]
    found = np.unique(low[1:][same]).astype(np.int64) | (table.column("bucket")[0].as_py() << 32)
    return pa.table({"hash": pa.array(found, pa.int64())})


def repeated_hashes(packed: DataFrame, bits: int):
    """Bit map of hashes that stand at least twice in the rows of :func:`packed_hashes`; it may hold a few others, so it only spares work."""
    return bit_map(packed.groupBy("bucket").applyInArrow(_twice, "hash long"), "hash", bits)


def bit_map(rows: DataFrame, column: str, bits: int):
    """Broadcast bit map of ``bits`` bits (a power of two, whatever the input) with the column's values set.

    It answers "maybe" for values that were never set once it fills up; use it only to spare work.
    """
    at = F.pmod(F.col(column), F.lit(bits)).cast("long")
    bucket = F.shiftright(at, 15).alias("_bucket")
    parts = rows.select(bucket, at.bitwiseAND(32767).alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.toLocalIterator():
        own = np.frombuffer(bytes(r["_map"]), np.uint8)
        out[r["_bucket"] << 12 : (r["_bucket"] << 12) + len(own)] = own[: bits // 8]
    return rows.sparkSession.sparkContext.broadcast(out)


def in_bit_map(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values.astype(np.int64) & (len(bits) * 8 - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
