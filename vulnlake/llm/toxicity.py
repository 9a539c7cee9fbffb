"""Toxicity by a classifier chain.

Categories are predicted one after the other, from narrow ones to the overall verdict.  Each link is a
logistic regression over counts of words and stems and the probabilities of the links before it.  While training, those
probabilities come from out-of-fold predictions, so a link learns how much the earlier ones can be trusted on
documents they have not seen; the final links are then fitted on all training rows.

The overall verdict is learnt from the labelled rows.  Labels carry no finer categories, so a category's
training label is: the document is labelled toxic and holds a word of the category's seed list.  Seed lists only
make training labels; at prediction every weight is a learnt one.

Folds go by a hash of the text, so copies of a text are held out together.

The models are fitted on at most ``max_train`` labelled documents, drawn by a hash of the id (the documented
bound); scoring reads every document whole.  Null and empty texts score as texts without words; documents
without a label are scored like the others; without labelled documents of both kinds all probabilities are 0
and nothing is rejected; repeated rows are scored each for itself.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnlake.llm.common import pieces, texts_of, whole_row
from vulnlake.session import cut_lineage

TOKEN = re.compile(r"[^\W\d_]+")
STEM = 4

#: Seed words of each narrow category, in chain order; the last link, ``toxic``, needs none.
SEEDS = (
    ("insult", ("idiot", "moron", "clown", "loser", "fool", "stupid")),
    ("contempt", ("worthless", "pathetic", "scum", "useless")),
    ("disgust", ("trash", "disgusting", "garbage", "filth")),
)
VERDICT = "toxic"


def tokens_of(text: str) -> Counter:
    """Counts of the words of a text and of their stems (the first ``STEM`` letters and a star)."""
    counts = Counter(TOKEN.findall(text.lower()))
    for w, c in list(counts.items()):
        if len(w) > STEM:
            counts[w[:STEM] + "*"] += c
    return counts


@dataclass(frozen=True)
class Link:
    """One logistic regression: weights of the vocabulary, then of the earlier links' probabilities."""

    words: np.ndarray
    earlier: np.ndarray
    bias: float

    def predict(self, x: np.ndarray, before: np.ndarray) -> np.ndarray:
        z = x @ self.words + self.bias
        if before.shape[1]:
            z = z + before @ self.earlier
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


@dataclass(frozen=True)
class Chain:
    names: tuple[str, ...]
    vocabulary: dict[str, int]
    links: tuple[Link, ...]

    def features(self, text: str) -> tuple[list[int], list[float]]:
        counts = tokens_of(text)
        common = counts.keys() & self.vocabulary.keys()
        return [self.vocabulary[w] for w in common], [float(np.log1p(counts[w])) for w in common]

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 0))
        for link in self.links:
            out = np.column_stack([out, link.predict(x, out)])
        return out


def fit_link(x: np.ndarray, before: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 12) -> Link:
    """Newton's method for logistic regression with an L2 penalty; ``x`` is dense and narrow."""
    full = np.column_stack([x, before, np.ones(len(x))])
    w = np.zeros(full.shape[1])
    penalty = np.full(full.shape[1], l2)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(full @ w, -40, 40)))
        gradient = full.T @ (p - y) + penalty * w
        hessian = (full * (p * (1 - p))[:, None]).T @ full + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    k = x.shape[1]
    return Link(w[:k], w[k:-1], float(w[-1]))


def tells(df: int, hits: int, n: int, positive: float) -> float:
    """Normal score of a word's documents among the toxic ones."""
    share = positive / n
    return abs(hits - df * share) / np.sqrt(df * share * (1 - share) * max(1 - df / n, 1e-9) + 1e-9)


def most_telling(counts: Iterable[tuple[str, int, int]], n: int, positive: float, words: int, least_docs: int) -> dict[str, int]:
    """The ``words`` words that tell the labels apart best, from (word, documents, toxic documents)."""
    usable = [(w, tells(df, hits, n, positive)) for w, df, hits in counts if df >= min(least_docs, positive)]
    return {w: i for i, (w, _) in enumerate(sorted(usable, key=lambda p: (-p[1], p[0]))[:words])}


def fit_matrix(
    x: np.ndarray, seeded: np.ndarray, toxic: np.ndarray, fold: np.ndarray, vocabulary: dict[str, int], seeds=SEEDS, l2: float = 0.3,
) -> Chain:
    """Train the links on word values (rows x vocabulary), seed words of each category seen (rows x seeds) and labels."""
    y = toxic.astype(float)
    targets = [y * seeded[:, j] for j in range(seeded.shape[1])] + [y]
    before, links = np.zeros((len(y), 0)), []
    for target in targets:
        unseen = np.zeros(len(y))
        for k in np.unique(fold):
            rest = fold != k
            if not rest.any():
                continue
            unseen[~rest] = fit_link(x[rest], before[rest], target[rest], l2).predict(x[~rest], before[~rest])
        links.append(fit_link(x, before, target, l2))
        before = np.column_stack([before, unseen])
    return Chain((*[n for n, _ in seeds], VERDICT), vocabulary, tuple(links))


def fold_of(text: str, folds: int) -> int:
    """Fold by a hash of the text, so copies of a text are never on both sides."""
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % folds


def values_of(counts: dict[str, int], vocabulary: dict[str, int]) -> np.ndarray:
    out = np.zeros(len(vocabulary))
    for w in counts.keys() & vocabulary.keys():
        out[vocabulary[w]] = np.log1p(counts[w])
    return out


def fit_chain(
    texts: Sequence[str], toxic: Sequence[int], seeds=SEEDS, folds: int = 4, words: int = 120, least_docs: int = 5, l2: float = 0.3,
) -> Chain:
    """Train on labelled texts; the vocabulary is the ``words`` words that tell the labels apart best."""
    y = np.asarray(toxic, float)
    if not len(y) or y.min() == y.max():
        return Chain((*[n for n, _ in seeds], VERDICT), {}, ())
    counted = [tokens_of(t) for t in texts]
    df, hits = Counter(), Counter()
    for c, t in zip(counted, y, strict=True):
        df.update(c.keys())
        if t:
            hits.update(c.keys())
    vocabulary = most_telling(((w, d, hits[w]) for w, d in df.items()), len(y), y.sum(), words, least_docs)
    x = np.array([values_of(c, vocabulary) for c in counted])
    seeded = np.array([[float(any(w in c for w in listed)) for _, listed in seeds] for c in counted])
    return fit_matrix(x, seeded, y, np.array([fold_of(t, folds) for t in texts]), vocabulary, seeds, l2)


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """Text and label of labelled documents, at most ``max_train`` ids drawn by a hash; the bound makes a broadcast safe."""
    known = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.md5(F.concat(F.lit("toxicity:"), F.col("doc_id").cast("string")))
    drawn = known.orderBy(order, "doc_id").limit(max_train).withColumn("_order", order)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id", "text"])
    return rows.select("doc_id", "toxic", "_order", F.md5("text").alias("_which"), F.length("text").alias("_length"), "text")


def _counted(batches: Iterable[pa.RecordBatch], folds: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        texts = texts_of(batch.column(3))
        counts = [tokens_of(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array([fold_of(t, folds) for t in texts], pa.int32()),
             pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))],
            ["doc_id", "which", "toxic", "fold", "words", "counts"])


def _as_values(batches: Iterable[pa.RecordBatch], vocabulary: dict[str, int], seeds) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [dict(zip(w, c, strict=True)) for w, c in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
        x = [values_of(c, vocabulary).tobytes() for c in counts]
        seeded = [[any(w in c for w in listed) for _, listed in seeds] for c in counts]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array(x, pa.binary()), pa.array(seeded, pa.list_(pa.bool_()))],
            ["doc_id", "which", "toxic", "fold", "x", "seeded"])


def train(
    docs: DataFrame, labels: DataFrame, max_train: int = 6000, max_mb: int = 64, seeds=SEEDS, folds: int = 4, words: int = 120,
    least_docs: int = 5, l2: float = 0.3,
) -> Chain:
    """Fit the chain on a bounded, hashed sample of the labelled documents (at most ``max_mb`` MB of text, whole ones).

    Words are counted on the executors and the vocabulary comes from an aggregation; the driver holds sizes, then a row
    of numbers for each document, never a text.  A text that does not fit any more is passed over; it is an error if
    that leaves no text of a label that was drawn.
    """
    rows = training_rows(docs, labels, max_train)
    sizes = rows.select("_order", "doc_id", "_which", "toxic", "_length").orderBy("_order", "doc_id", "_which").limit(max_train).collect()
    used, left = [], max_mb << 20
    for row in sizes:
        if row._length <= left:
            left -= row._length
            used.append((row.doc_id, row._which, row.toxic))
    kinds = {toxic for _, _, toxic in used}
    if kinds != {row.toxic for row in sizes} and len({row.toxic for row in sizes}) > 1:
        raise ValueError("the labelled texts of one kind do not fit into max_mb")
    if len(kinds) < 2:
        return Chain((*[n for n, _ in seeds], VERDICT), {}, ())
    kind = dict(docs.dtypes)["doc_id"]
    picked = docs.sparkSession.createDataFrame([u[:2] for u in used], f"doc_id {kind}, _which string")  # at most ``max_train`` rows
    texts = rows.join(F.broadcast(picked), ["doc_id", "_which"]).select("doc_id", "_which", "toxic", "text")
    counted = cut_lineage(texts.mapInArrow(
        lambda batches: _counted(batches, folds), f"doc_id {kind}, which string, toxic int, fold int, words array<string>, counts array<int>"))
    n, positive = len(used), float(sum(toxic for _, _, toxic in used))
    seen = counted.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("df"), F.sum("toxic").alias("hits")).filter(F.col("df") >= min(least_docs, positive))
    share = positive / n
    spread = F.col("df") * share * (1 - share) * F.greatest(1 - F.col("df") / n, F.lit(1e-9)) + 1e-9
    best = seen.withColumn("tells", F.abs(F.col("hits") - F.col("df") * share) / F.sqrt(spread)).orderBy(F.desc("tells"), "word").limit(words)
    vocabulary = most_telling(((r.word, r.df, r.hits) for r in best.collect()), n, positive, words, least_docs)
    values = counted.mapInArrow(
        lambda batches: _as_values(batches, vocabulary, seeds), f"doc_id {kind}, which string, toxic int, fold int, x binary, seeded array<boolean>")
    found = sorted(values.collect(), key=lambda r: (r.doc_id, r.which))
    x = np.array([np.frombuffer(r.x) for r in found]).reshape(len(found), len(vocabulary))
    return fit_matrix(
        x, np.array([r.seeded for r in found], float).reshape(len(found), len(seeds)), np.array([r.toxic for r in found]),
        np.array([r.fold for r in found]), vocabulary, seeds, l2)


def _scored(batches: Iterable[pa.RecordBatch], chain: Chain) -> Iterator[pa.RecordBatch]:
    names = [f"p_{n}" for n in chain.names]
    for batch in pieces(batches, "_text"):
        x = np.zeros((batch.num_rows, len(chain.vocabulary)))
        if chain.links:
            for i, text in enumerate(texts_of(batch.column(batch.schema.get_field_index("_text")))):
                at, values = chain.features(text)
                x[i, at] = values
            p = chain.predict(x)
        else:
            p = np.zeros((batch.num_rows, len(names)))
        rest = [(f, batch.column(i)) for i, f in enumerate(batch.schema.names) if f != "_text"]
        yield pa.RecordBatch.from_arrays(
            [c for _, c in rest] + [pa.array(p[:, j]) for j in range(len(names))], [f for f, _ in rest] + names
        )


def score(docs: DataFrame, chain: Chain, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of every document and p_<category> of each link."""
    rows = docs.select(*keep, F.col("text").alias("_text"))
    kept = [f for f in rows.schema.fields if f.name != "_text"]
    kinds = [T.StructField(f"p_{n}", T.DoubleType()) for n in chain.names]
    return rows.mapInArrow(lambda batches: _scored(batches, chain), T.StructType(kept + kinds))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_train: int = 6000) -> DataFrame:
    """doc_id, the probability of every category and ``toxic`` (the verdict's is at least ``threshold``)."""
    chain = train(docs, labels, max_train)
    return score(docs, chain).withColumn("toxic", F.col(f"p_{VERDICT}") >= threshold)


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_train: int = 6000) -> DataFrame:
    """The documents that are not toxic, with the columns of the input."""
    chain = train(docs, labels, max_train)
    packed = docs.select(whole_row(docs).alias("doc"), "text")
    return score(packed, chain, ["doc"]).filter(F.col(f"p_{VERDICT}") < threshold).select("doc.*")
