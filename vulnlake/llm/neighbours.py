"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by three rounds of random signs and a fast Hadamard transform, and hashed to the nearest
signed axis.  Each table has a rotation of its own.  A query probes, per table, the axes nearest to it; the rows
found there are ranked exactly by cosine in double precision on the original vectors.

A bucket is a set of blocks of bounded size, as many as its count asks for, so a hot bucket (a very common
vector) is many small tasks; the queries of a bucket are dealt over parts of bounded size, and a block is a pair
of both.  A block returns only each query's best rows.  A query that finds fewer rows than
asked for looks through all buckets of one table, which is an exact search.

Vectors that are null, zero, or hold null or non-finite components take no part, as queries or rows; nor do rows
without an id.  Only vectors of the same length meet.  Ties go to the smaller id.  Rows that repeat an id are
one candidate (its best) and, as a query, one query (its smallest vector).  Recall depends on ``tables`` and
``probes``: with 6 tables and an eighth of the axes, tests find at least 0.9 of the true neighbours.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vulnlake.llm.common import cut_lineage

TABLES = 6
PROBE_SHARE = 0.125
BLOCK_ROWS = 4096
PART_QUERIES = 20_000
BLOCK_QUERIES = 2048
SEED = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, width = x.shape
    h = 1
    while h < width:
        y = x.reshape(n, width // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], 2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


def axes(vectors: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    """The rotated vectors' components along +axis 0.., then -axis 0.."""
    width = 1 << max(0, int(vectors.shape[1] - 1).bit_length())
    x = np.zeros((len(vectors), width))
    x[:, : vectors.shape[1]] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    signs = np.random.default_rng([seed, table, width])
    for _ in range(3):
        x = hadamard(x * signs.choice([-1.0, 1.0], width))
    return np.concatenate([x, -x], 1)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The vectors with their largest component between a half and one: squares neither overflow nor vanish.

    The factor is a power of two, so cosines stay what they are to the last bit.
    """
    vectors = vectors.astype(np.float64)
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, keepdims=True, initial=0))[1])


def _valid(vector: Column) -> Column:
    big = F.lit(float("inf"))
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    return F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (by place) and vectors of each length in the batch."""
    lists = batch.column("vector")
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    for width in np.unique(sizes):
        at = np.flatnonzero(sizes == width)
        yield at, flat[starts[at][:, None] + np.arange(width)]


def _bucketed(batches: Iterable[pa.RecordBatch], tables: int, probes: float, blocks: dict | None, asking: bool) -> Iterator[pa.RecordBatch]:
    """Rows (width, tab, bucket, block, id, data); a query has one per probed block, a row one per table and part of the queries.

    ``blocks`` has the numbers of row blocks and of query parts of each bucket; a pair of both is a block.
    """
    for batch in batches:
        ids = batch.column("id").to_numpy()
        out: list[list] = [[] for _ in range(6)]
        for at, vectors in _vectors(batch):
            vectors = scaled(vectors)
            data = [v.tobytes() for v in np.ascontiguousarray(vectors, np.float64)]
            for table in range(tables):
                along = axes(vectors, table)
                if asking:
                    n = max(1, round(along.shape[1] * probes))
                    near = np.argsort(-along, axis=1, kind="stable")[:, :n]
                else:
                    near = along.argmax(1)[:, None]
                for row, buckets in enumerate(near.tolist()):
                    for bucket in buckets:
                        key = (vectors.shape[1], table, bucket)
                        n_blocks, parts = (1, 1) if blocks is None else blocks.get(key, (0, 1))
                        spread = int(ids[at[row]]) * 0x9E3779B97F4A7C15 >> 20
                        if asking:
                            chosen = range(spread % parts, n_blocks * parts, parts)
                        else:
                            own = spread % max(1, n_blocks)
                            chosen = range(own * parts, (own + 1) * parts)
                        for block in chosen:
                            for column, value in zip(out, (*key, block, ids[at[row]], data[row] if blocks is not None else b""), strict=True):
                                column.append(value)
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["width", "tab", "bucket", "block", "id", "data"])


BUCKETED = "width int, tab int, bucket int, block int, id long, data binary"


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows, the same for equal vectors wherever they stand."""
    return (q * x).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1)))


def _best(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    names = ["query_id", "vec_id", "score"]
    if not len(queries) or not len(rows):
        return pd.DataFrame({n: pd.Series(dtype="float64" if n == "score" else "int64") for n in names})
    x = np.stack([np.frombuffer(d) for d in rows["data"]])
    ids = rows["id"].to_numpy()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = []
    for at in range(0, len(queries), BLOCK_QUERIES):
        part = queries.iloc[at : at + BLOCK_QUERIES]
        q, of = np.stack([np.frombuffer(d) for d in part["data"]]), part["id"].to_numpy()
        near = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ unit.T
        near[of[:, None] == ids[None, :]] = -np.inf
        last = np.partition(near, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))]
        a, b = np.nonzero(np.isfinite(near) & (near >= last[:, None] - 1e-9))  # all that may be among the best or tie with them
        score = cosines(q[a], x[b])
        order = np.lexsort((ids[b], -score, of[a]))
        a, b, score = a[order], b[order], score[order]
        first = np.maximum.accumulate(np.where(np.append(True, a[1:] != a[:-1]), np.arange(len(a)), 0))
        kept = np.arange(len(a)) - first < k
        out.append(pd.DataFrame({"query_id": of[a[kept]], "vec_id": ids[b[kept]], "score": score[kept]}))
    return pd.concat(out)


def _blocks(rows: DataFrame, queries: DataFrame, tables: int, probes: float) -> dict[tuple[int, int, int], tuple[int, int]]:
    """Numbers of row blocks and of query parts of each bucket that has rows; there are two buckets per dimension and table."""
    found: list[dict] = []
    for side, asking, most in ((rows, False, BLOCK_ROWS), (queries, True, PART_QUERIES)):
        counted = side.mapInArrow(lambda b, asking=asking: _bucketed(b, tables, probes, None, asking), BUCKETED)
        counts = counted.groupBy("width", "tab", "bucket").count().collect()
        found.append({(r["width"], r["tab"], r["bucket"]): -(-r["count"] // most) for r in counts})
    return {key: (n, found[1].get(key, 1)) for key, n in found[0].items()}


def _searched(rows: DataFrame, queries: DataFrame, k: int, tables: int, probes: float) -> DataFrame:
    blocks = _blocks(rows, queries, tables, probes)
    key = ["width", "tab", "bucket", "block"]
    held = rows.mapInArrow(lambda b: _bucketed(b, tables, probes, blocks, False), BUCKETED)
    asked = queries.mapInArrow(lambda b: _bucketed(b, tables, probes, blocks, True), BUCKETED)
    best = asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(lambda q, r: _best(q, r, k), "query_id long, vec_id long, score double")
    best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(
    vectors: DataFrame, queries: Column, k: int = 5, tables: int = TABLES, probes: float = PROBE_SHARE,
    id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest rows found for each row that ``queries`` selects: query_id, rank (from 1), vec_id, score."""
    rows = vectors.filter(F.col(id_column).isNotNull() & _valid(F.col(vector_column)))
    picked = F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector")
    asked = rows.filter(queries).select(*picked).groupBy("id").agg(F.min("vector").alias("vector"))
    rows = rows.select(*picked)
    found = cut_lineage(_searched(rows, asked, k, tables, probes))
    full = found.groupBy(F.col("query_id").alias("_q")).count().filter(F.col("count") >= k)
    short = cut_lineage(asked.join(full, F.col("id") == F.col("_q"), "left_anti"))
    if short.isEmpty():
        return found
    whole = _searched(rows, short, k, 1, 1.0)
    return found.join(full, F.col("query_id") == F.col("_q"), "left_semi").unionAll(whole)
