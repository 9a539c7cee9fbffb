"""Ranked lexical search over a term-partitioned index, evaluated as a pipeline.

The terms that any item asks for are dealt to owners by how many documents hold them: the first owner has the rarest
terms, the last one the most frequent.  Items travel in bundles.  A bundle carries, for each of its items, a sparse
accumulator (document, score so far) from owner to owner; each owner's stage is a cogroup of the bundles with its
postings, and adds integer contributions.  After the last owner the best documents are selected.

Postings and bundles are both split by blocks of documents, so neither a frequent term nor a long accumulator ever
stands in one task: a group holds one block (at most 16 MB of text, or one document) and one bundle.

An accumulator is dropped, or not opened, only where it provably cannot count: contributions are never negative, and
the term's weight times the largest possible share bounds what is still to come.  A document whose score and bound stay
below the block's k-th best score so far cannot be among the k best.  The result is exact, but for collisions of
64-bit term hashes.

Null and empty texts have no terms and are not counted.  An item without terms, or whose terms no document holds, has
no rows.  Rows that repeat a doc_id are documents of their own; ties in score and doc_id keep any order, a null doc_id
comes first.  Rows that share an item_id are one item.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vulnlake.llm.common import _LOWER, RangeHash, bit_map, buffer_of, give_back, in_bit_map, pieces, word_bounds
from vulnlake.session import cut_lineage

#: Largest share of documents that hold a term of each owner but the last.
SHARES = (0.001, 0.01, 0.1)
BUNDLE = 256
BLOCK_BYTES = 16 << 20
HASHED_BYTES = 1 << 20
MAP_BITS = 1 << 24
ONE = 1_000_000_000

_TERM = np.zeros(256, bool)
for _from, _to in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _TERM[_from:_to] = True

LEFT = "block long, bundle long, header boolean, item_id long, ids array<long>, docs binary, scores binary"


def term_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every term of an Arrow column of texts."""
    data, rows = buffer_of(column)
    start, end, row = word_bounds(np.where(_TERM[data], data, 32).astype(np.uint8), rows)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return RangeHash(_LOWER[data], 17)(start, end).view(np.int64), row


def _item_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "_text"):
        hashes, row = term_hashes(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(hashes)], ["item_id", "term"])


def _narrow(counts: np.ndarray) -> bytes:
    for kind in (np.uint8, np.uint16, np.uint32):
        if counts.max() <= np.iinfo(kind).max:
            return counts.astype(kind).tobytes()
    return counts.astype(np.uint64).tobytes()


def _wide(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(packed) // n]).astype(np.int64)


def _indexed(batches: Iterable[pa.RecordBatch], asked, limit: int) -> Iterator[pa.RecordBatch]:
    """One header row a block (ids and lengths of its documents), one row for each asked term in it."""
    part, number = TaskContext.get().partitionId(), 0
    for batch in (b.slice(at, 1 << 16) for b in pieces(batches, "_text", limit) for at in range(0, b.num_rows, 1 << 16)):
        length, found = np.zeros(batch.num_rows, np.int64), []
        first = 0
        for piece in pieces([batch], "_text", HASHED_BYTES):  # hashing takes some forty bytes for one of text
            hashes, row = term_hashes(piece.column(1))
            length[first : first + piece.num_rows] = np.bincount(row, minlength=piece.num_rows)
            kept = in_bit_map(asked.value, hashes)
            found.append((hashes[kept], row[kept] + first))
            first += piece.num_rows
        hashes, row = (np.concatenate(x) for x in zip(*found, strict=True))
        terms, of = np.unique(hashes, return_inverse=True)
        pairs, tf = np.unique(of * batch.num_rows + row, return_counts=True)
        of, doc = np.divmod(pairs, batch.num_rows)
        bounds = np.searchsorted(of, np.arange(len(terms) + 1))
        docs, tfs, most = [], [], []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            docs.append(doc[lo:hi].astype(np.uint16).tobytes())
            tfs.append(_narrow(tf[lo:hi]))
            most.append(int(tf[lo:hi].max()))
        n, ids = len(terms), batch.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([(part << 32) + number] * (n + 1), pa.int64()),
                pa.array([None, *terms.tolist()], pa.int64()),
                pa.array([int((length > 0).sum()), *np.diff(bounds).tolist()], pa.int64()),
                pa.array([int(length.sum()), *most], pa.int64()),
                pa.array([ids] + [None] * n, pa.list_(pa.int64())),
                pa.array([b"", *docs], pa.binary()),
                pa.array([length.astype(np.int64).tobytes(), *tfs], pa.binary()),
            ],
            ["block", "term", "n", "most", "ids", "docs", "tfs"],
        )
        number += 1


def index(docs: DataFrame, asked, limit: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of the inverted index, for the terms of the bit map ``asked``; written once, read by every stage."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    made = rows.mapInArrow(
        lambda batches: _indexed(batches, asked, limit),
        "block long, term long, n long, most long, ids array<long>, docs binary, tfs binary",
    )
    return cut_lineage(made)


def _best(score: np.ndarray, k: int) -> int:
    """The k-th largest score, 0 if there are fewer."""
    return int(np.partition(score, -k)[-k]) if len(score) >= k else 0


def add_stage(left: pa.Table, right: pa.Table, n_docs: int, n_terms: int, k: int, last: bool) -> pa.Table:
    """One owner's work on one bundle and block: add its terms' contributions, drop what cannot reach the k best."""
    rows = left.to_pylist()
    header = next(r for r in rows if r["header"])
    length = np.frombuffer(header["scores"], np.int64)
    m = 100 - 50 + (50 * length * n_docs) // max(n_terms, 1)
    state = {r["item_id"]: (np.frombuffer(r["docs"], np.uint16), np.frombuffer(r["scores"], np.int64)) for r in rows if not r["header"]}
    asked: dict = {}
    for at, term in enumerate(right.select(["docs", "tfs", "weight", "items"]).to_pylist()):
        doc = np.frombuffer(term["docs"], np.uint16)
        tf = _wide(term["tfs"], len(doc))
        share = term["weight"] * ((ONE * tf) // (1000 * tf + 20 * m[doc]))
        for item in term["items"]:
            asked.setdefault(item["item_id"], [item["now"], item["later"], []])[2].append((doc, share))
    for item, (now, later, parts) in asked.items():
        doc, score = state.get(item, (np.zeros(0, np.uint16), np.zeros(0, np.int64)))
        dense = np.zeros(len(m), np.int64)
        dense[doc] = score
        opened = now >= _best(score, k)
        for docs, share in parts:
            dense[docs] += share
        doc = np.flatnonzero(dense).astype(np.uint16) if opened else doc
        score = dense[doc]
        kept = score + later >= _best(score, k)
        state[item] = (doc[kept], score[kept])
    if last:
        found = []
        for item, (doc, score) in state.items():
            near = [(-s, header["ids"][d] is not None, header["ids"][d] or 0, d) for d, s in zip(doc.tolist(), score.tolist(), strict=True) if s > 0]
            found += [(item, header["ids"][d], -s) for s, _, _, d in sorted(near)[:k]]
        kinds = [("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())]
        return pa.table({n: pa.array([f[i] for f in found], t) for i, (n, t) in enumerate(kinds)})
    give_back()
    out = [header, *(
        {"block": header["block"], "bundle": header["bundle"], "header": False, "item_id": item, "ids": None, "docs": doc.tobytes(), "scores": score.tobytes()}
        for item, (doc, score) in state.items()
    )]
    return pa.Table.from_pylist(out, left.schema)


def _stage(n_docs: int, n_terms: int, k: int, last: bool):
    return lambda left, right: add_stage(left, right, n_docs, n_terms, k, last)


def search(docs: DataFrame, items: DataFrame, k: int = 50, bundle: int = BUNDLE, limit: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of every item's ``k`` best documents."""
    asked = items.select(F.col("item_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    terms = cut_lineage(asked.mapInArrow(_item_terms, "item_id long, term long").distinct())
    blocks = index(docs, bit_map(terms, "term", MAP_BITS), limit)
    total = blocks.filter("term IS NULL").agg(F.sum("n"), F.sum("most")).first()
    n_docs, n_terms = int(total[0] or 0), int(total[1] or 0)
    known = blocks.filter("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("df"), F.max("most").alias("most"))

    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    owner = F.lit(0)
    for share in SHARES:
        owner = owner + (F.col("df") > share * n_docs).cast("int")
    largest = (F.lit(ONE) * F.col("most") / (1000 * F.col("most") + 1000)).cast("long") + 1  # m is 50 at least
    dealt = terms.join(known, "term").withColumns({"weight": weight, "owner": owner}).withColumn("most", F.col("weight") * largest)
    bounds = dealt.groupBy("item_id").agg(*[F.sum(F.when(F.col("owner") >= s, F.col("most")).otherwise(0)).alias(f"b{s}") for s in range(len(SHARES) + 2)])
    n_bundles = max(1, math.ceil(bounds.count() / bundle))
    later = F.array(*[F.col(f"b{s}") for s in range(len(SHARES) + 2)])
    same = F.col("item_id").eqNullSafe(F.col("_item"))
    dealt = dealt.join(bounds.withColumnRenamed("item_id", "_item"), same).select(
        F.pmod(F.xxhash64("item_id"), F.lit(n_bundles)).alias("bundle"), "term", "owner", "weight",
        F.struct("item_id", later[F.col("owner")].alias("now"), later[F.col("owner") + 1].alias("later")).alias("item"),
    )
    dealt = cut_lineage(dealt.groupBy("bundle", "term", "owner", "weight").agg(F.collect_list("item").alias("items")))

    postings = blocks.filter("term IS NOT NULL").select("block", "term", "docs", "tfs").join(dealt, "term")
    carried = blocks.filter("term IS NULL").select(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bundles - 1).cast("long"))).alias("bundle"), F.lit(True).alias("header"),
        F.lit(None).cast("long").alias("item_id"), "ids", F.lit(b"").alias("docs"), F.col("tfs").alias("scores"),
    )
    for stage in range(len(SHARES) + 1):
        last = stage == len(SHARES)
        owned = postings.filter(F.col("owner") == stage).select(
            F.col("block").alias("_block"), F.col("bundle").alias("_bundle"), "docs", "tfs", "weight", "items"
        )
        carried = carried.groupBy("block", "bundle").cogroup(owned.groupBy("_block", "_bundle")).applyInArrow(
            _stage(n_docs, n_terms, k, last), "item_id long, doc_id long, score long" if last else LEFT,
        )
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = carried.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def sql(k: int = 50) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {found} AS terms FROM documents),
postings AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY r, term),
sizes AS (SELECT r, doc_id, len(terms) AS n FROM docs WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS big_n, coalesce(sum(n), 0)::BIGINT AS l FROM sizes),
asked AS (SELECT DISTINCT item_id, unnest({found}) AS term FROM benchmark),
weights AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), total),
scores AS (
  SELECT a.item_id, s.doc_id, p.r,
    sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * big_n) // l))))::BIGINT AS score
  FROM asked a JOIN weights USING (term) JOIN postings p USING (term) JOIN sizes s ON s.r = p.r, total
  GROUP BY a.item_id, s.doc_id, p.r),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {k}
"""
