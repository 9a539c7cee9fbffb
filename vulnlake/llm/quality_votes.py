"""Quality by votes of the nearest labelled documents in a latent-semantic space.

A text's terms are its words (lower-cased), its words' shapes (``Aa,`` for ``House,``; ``a###`` for ``word###``), both
hashed to places, and its echoes: words that repeat the word up to ``ECHOES`` places before, one term per distance.  Square roots of the counts, weighted by inverse document frequency, are
projected on the leading singular vectors of the labelled sample.  The labelled vectors are broadcast; every document
is compared with all of them, block by block, and the labels of its ``neighbours`` nearest ones vote, weighted by
cosine.  The search is exact: no index, no candidate is left out.

The space and the voters come from at most ``max_train`` labelled documents, drawn by a hash of the id (the documented
bound, which also bounds the broadcast: ``max_train * rank`` numbers); terms are counted on the executors and the
driver sees counts only.  Every document is scored from its whole text alone.

Null and empty texts have no terms and get the share of label 1 among the voters, as does every text without a known
term.  Without labelled documents the score is 0.5.  Repeated rows are scored each for itself; a document that is
labelled twice counts as 1 if one of its rows says so; labels other than 0 and 1 do not count.  A null id is held out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import _LOWER, RangeHash, buffer_of, pieces, word_bounds

DIMENSIONS = 1 << 12
ECHOES = 4
FOLDS = 5
ROWS = 256

#: Letters of either case and bytes beyond ASCII become one letter each; other bytes stand for themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58] = ord("0")
_SHAPE[65:91] = ord("A")
_SHAPE[97:123] = ord("a")
_SHAPE[128:] = ord("a")


def held_out(doc_id: Column) -> Column:
    """Whether an id's row may not be learnt from: crc32 of the id as text leaves no remainder."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def term_places(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of every term of an Arrow column of texts: words in the lower half, shapes in the upper, echoes last."""
    data, rows = buffer_of(column)
    start, end, row = word_bounds(data, rows)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    half = DIMENSIONS // 2
    words = RangeHash(_LOWER[data], 11)(start, end)
    rows_of, places = [row], [(words % np.uint64(half)).astype(np.int64)]
    shape = _SHAPE[data]
    changes = np.ones(len(data), bool)
    changes[1:] = shape[1:] != shape[:-1]
    changes[start] = True
    short = np.concatenate([[0], np.cumsum(changes)])
    shapes = RangeHash(shape[changes], 13)(short[start], short[end]) % np.uint64(half - ECHOES)
    rows_of.append(row)
    places.append(shapes.astype(np.int64) + half)
    for lag in range(1, ECHOES + 1):
        again = row[lag:][(words[lag:] == words[:-lag]) & (row[lag:] == row[:-lag])]
        rows_of.append(again)
        places.append(np.full(len(again), DIMENSIONS - lag))
    return np.concatenate(rows_of), np.concatenate(places)


def term_counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of at most ``ROWS`` rows as (first row, rows x places)."""
    row, place = term_places(column)
    order = np.argsort(row, kind="stable")
    row, place = row[order], place[order]
    for first in range(0, len(column), ROWS):
        n = min(ROWS, len(column) - first)
        lo, hi = np.searchsorted(row, (first, first + n))
        flat = np.bincount((row[lo:hi] - first) * DIMENSIONS + place[lo:hi], minlength=n * DIMENSIONS)
        yield first, flat.reshape(n, DIMENSIONS)


def _normalised(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


@dataclass(frozen=True)
class Voters:
    """The labelled vectors and the projection that puts any document beside them."""

    weights: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int

    def project(self, counts: np.ndarray) -> np.ndarray:
        return _normalised(_normalised(np.sqrt(counts).astype(np.float32) * self.weights) @ self.basis)

    def vote(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest voters, weighted by cosine (negative ones have no vote)."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        near = self.project(counts) @ self.vectors.T
        k = min(self.neighbours, len(self.labels))
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        cosine = np.maximum(np.take_along_axis(near, best, 1), 0).astype(np.float64)
        total = cosine.sum(1)
        share = (cosine * self.labels[best]).sum(1)
        return np.where(total > 1e-6, np.clip(share / np.maximum(total, 1e-6), 0, 1), self.labels.mean())


def leading_vectors(x: np.ndarray, rank: int, rounds: int = 4, seed: int = 5) -> np.ndarray:
    """Right singular vectors of the ``rank`` largest singular values, by subspace iteration from a fixed start."""
    rank = min(rank, *x.shape)
    q = np.random.default_rng(seed).standard_normal((x.shape[1], min(rank + 8, x.shape[1]))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray((q @ v[:rank].T).astype(np.float32))


def fit_voters(counts: np.ndarray, labels: Sequence[int], rank: int = 32, neighbours: int = 15) -> Voters:
    """Weights, basis and voters of labelled term counts (documents x places)."""
    y = np.asarray(labels, np.float64)
    if not len(y):
        return Voters(np.zeros(DIMENSIONS, np.float32), np.zeros((DIMENSIONS, 1), np.float32), np.zeros((0, 1), np.float32), y, neighbours)
    df = (counts > 0).sum(0)
    weights = np.where(df > 0, np.log((1 + len(y)) / (1 + df)), 0).astype(np.float32)
    x = _normalised(np.sqrt(counts).astype(np.float32) * weights)
    basis = leading_vectors(x, rank)
    return Voters(weights, basis, _normalised(x @ basis), y, neighbours)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "_text"):
        places, counts = [], []
        for _, block in term_counts(batch.column(batch.schema.get_field_index("_text"))):
            for row in block:
                at = np.flatnonzero(row)
                places.append(at.astype(np.uint16).tobytes())
                counts.append(row[at].astype(np.uint32).tobytes())
        kept = [n for n in batch.schema.names if n != "_text"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index(n)) for n in kept] + [pa.array(places, pa.binary()), pa.array(counts, pa.binary())],
            kept + ["places", "counts"],
        )


def sample(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """Term counts and label of at most ``max_train`` labelled documents that are not held out, by a hash of the id."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).filter(~held_out(F.col("doc_id")))
    order = F.md5(F.concat(F.lit("quality:"), F.col("doc_id").cast("string")))
    drawn = known.groupBy("doc_id").agg(F.max("quality").alias("_label")).withColumn("_order", order)
    drawn = drawn.orderBy("_order", "doc_id").limit(max_train)
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    rows = texts.join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id", "_text"])
    rows = rows.select("_order", F.md5("_text").alias("_which"), "_label", "_text")
    counted = rows.mapInArrow(_counted, "_order string, _which string, _label int, places binary, counts binary")
    return counted.orderBy("_order", "_which").limit(max_train)


def train(docs: DataFrame, labels: DataFrame, max_train: int = 4000, **options) -> Voters:
    """The voters from the bounded sample; the driver receives term counts (at most ``DIMENSIONS`` a document)."""
    rows = sample(docs, labels, max_train).collect()
    counts = np.zeros((len(rows), DIMENSIONS), np.float32)
    for at, row in enumerate(rows):
        counts[at, np.frombuffer(row.places, np.uint16)] = np.frombuffer(row.counts, np.uint32)
    return fit_voters(counts, [row._label for row in rows], **options)


def _scored(batches: Iterable[pa.RecordBatch], voters) -> Iterator[pa.RecordBatch]:
    model = voters.value
    for batch in pieces(batches, "_text"):
        score = np.zeros(batch.num_rows)
        for first, block in term_counts(batch.column(batch.schema.get_field_index("_text"))):
            score[first : first + len(block)] = model.vote(block)
        kept = [n for n in batch.schema.names if n != "_text"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index(n)) for n in kept] + [pa.array(score)], kept + ["score"]
        )


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_train: int = 4000, **options) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if the score is at least ``threshold``) of every document."""
    voters = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_train, **options))
    rows = docs.select("doc_id", F.col("text").alias("_text"))
    kind = dict(docs.dtypes)["doc_id"]
    scored = rows.mapInArrow(lambda batches: _scored(batches, voters), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
