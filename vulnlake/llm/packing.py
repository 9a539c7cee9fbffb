"""Lexical retrieval packing: documents that share rare terms fill one another's windows.

Every document becomes token ids and an end id.  Whole windows of a long document are sequences of their own;
what is left of each document (its tail, shorter than a window) is packed with its lexical neighbours.  Tails
are ordered by the rarest two terms that another document holds together, too, then by further rare terms, and that
order is cut into shards of about a fixed number of documents, where neighbours share least: tails that share rare
terms meet in one shard (neighbours outside the shard are not looked for), and the number of shards, not their size, grows with the input.  Each shard holds a BM25 inverted index of its tails: a seed asks it with its rarest terms for
unused neighbours, best first, which fill the seed's window whole as long as they fit; the best one left is
cut to fill the window to the last token, and its rest is the next seed.  The rest of a shard that does not
fill a window is cut into sequences of powers of two, which need no padding either.

Null and empty texts are the end id alone; repeated rows are documents of their own; an empty table gives no
piece.  Only a shard's tails (at most a window a document) and window checksums meet in one task.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import bit_map, cut_lineage, give_back, in_bit_map, mixed, pieces
from vulnlake.session import arrow_batches

WINDOW = 2048
END_ID = 1
SHARD_DOCS = 512
CACHED_WORDS = 200_000
LEARNED = 1 << 13  # words that are tokenised together
BATCH_ROWS = 2000  # texts that go to a tokenising task at once
SIGN = "^"
QUERY_TERMS = 16
KEY_TERMS = 12
PAIR_BITS = 1 << 26
K1, B = 1.2, 0.75
#: white space that is not plain ASCII; a text with any is tokenised whole
ODD_SPACE = "[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Token ids of texts, each word tokenised once as long as it is remembered.

    The tokenizer never joins characters across white space, so the ids of a text are those of its words one
    after the other.  New words of several texts are tokenised together, a sign between each two; words that
    hold that sign, and texts with unusual white space, are tokenised alone.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u4") if self.tokenizer.get_vocab_size() > 1 << 16 else np.dtype("<u2")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        sign = self._ids(SIGN)
        self.sign = sign[0] if len(sign) == 1 else None

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, words: list[str]) -> None:
        """Remember different words; those of the generation before are taken over from it."""
        new = []
        for w in words:
            if w in self.older:
                self.known[w] = self.older[w]
            elif not w:
                self.known[w] = b""
            elif self.sign is None or SIGN in w or "<|" in w:
                self.known[w] = np.asarray(self._ids(w), self.kind).tobytes()
            else:
                new.append(w)
        for at in range(0, len(new), LEARNED):
            self._learn_together(new[at : at + LEARNED])

    def _learn_together(self, new: list[str]) -> None:
        """The tokenizer holds some hundred bytes for each token of what it gets at once, so it gets a few words."""
        ids = np.asarray(self._ids(f" {SIGN} ".join(new)), self.kind)
        signs = np.flatnonzero(ids == self.sign)
        if len(signs) != len(new) - 1:
            raise ValueError("the tokenizer joins words across white space")
        size = self.kind.itemsize
        starts = np.append(0, (signs + 1) * size).tolist()
        ends = np.append(signs * size, len(ids) * size).tolist()
        packed = ids.tobytes()
        self.known.update((w, packed[i:j]) for w, i, j in zip(new, starts, ends, strict=True))

    def batch(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Token ids of each text of a column of strings without nulls."""
        odd = pc.match_substring_regex(column, ODD_SPACE)
        lists = pc.ascii_split_whitespace(pc.if_else(odd, "", column))
        words = lists.flatten().dictionary_encode()
        listed = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > CACHED_WORDS:
            self.older, self.known = self.known, {}
        packed = list(map(self.known.get, listed))
        new = [i for i, ids in enumerate(packed) if ids is None]
        if new:
            self._learn([listed[i] for i in new])
            for i in new:
                packed[i] = self.known[listed[i]]
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // self.kind.itemsize
        starts = np.cumsum(sizes) - sizes
        blob = np.frombuffer(b"".join(packed), self.kind)
        code = words.indices.to_numpy(zero_copy_only=False)
        length = sizes[code]
        ends = np.concatenate([[0], np.cumsum(length)])
        ids = blob[np.repeat(starts[code] - ends[:-1], length) + np.arange(ends[-1])]
        bounds = ends[pc.list_value_length(lists).to_numpy(zero_copy_only=False).cumsum()]
        start = 0
        for i, (end, alone) in enumerate(zip(bounds.tolist(), odd.to_pylist(), strict=True)):
            yield np.asarray(self._ids(column[i].as_py()), self.kind) if alone else ids[start:end]
            start = end


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The tokenizer of a path, kept with its words while the process lives."""
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _tokenised(batches: Iterable[pa.RecordBatch], path: str, window: int, end_id: int) -> Iterator[pa.RecordBatch]:
    words = word_ids(path)
    for batch in pieces(batches, "text"):
        n_tokens, crcs, tails = [], [], []
        for ids in words.batch(batch.column("text").fill_null("")):
            ids = np.append(ids, words.kind.type(end_id))
            whole = len(ids) // window * window
            n_tokens.append(len(ids))
            crcs.append([_crc(ids[i : i + window]) for i in range(0, whole, window)])
            tails.append(ids[whole:].tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("salt"), batch.column("doc_id").cast(pa.int64()), pa.array(n_tokens, pa.int64()),
             pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.binary())],
            ["salt", "doc_id", "n_tokens", "crcs", "tail"],
        )


class Neighbours:
    """A BM25 inverted index of one shard's tails."""

    def __init__(self, tails: list[np.ndarray]) -> None:
        self.n = n = len(tails)
        sizes = np.array([len(t) for t in tails], np.int64)
        terms = np.concatenate(tails).astype(np.int64) if n else np.zeros(0, np.int64)
        keys, tf = np.unique(terms * n + np.repeat(np.arange(n), sizes), return_counts=True)
        term, self.doc = keys // max(n, 1), keys % max(n, 1)
        self.terms, first, df = np.unique(term, return_index=True, return_counts=True)
        self.first = np.append(first, len(keys))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        long = sizes[self.doc] / max(sizes.mean(), 1.0) if n else sizes
        which = np.repeat(np.arange(len(df)), df)
        self.weight = idf[which] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * long))
        # each document's shared terms, rarest first
        order = np.lexsort((which, -idf[which], self.doc))
        order = order[df[which[order]] > 1]
        self.asked = which[order]
        self.bounds = np.searchsorted(self.doc[order], np.arange(n + 1))

    def ranked(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents, nearest to the seed first; those that share no asked term come last."""
        score = np.zeros(self.n)
        for t in self.asked[self.bounds[seed] : self.bounds[seed + 1]][:QUERY_TERMS]:
            at = slice(self.first[t], self.first[t + 1])
            score[self.doc[at]] += self.weight[at]
        left = np.flatnonzero(unused)
        return left[np.argsort(-score[left], kind="stable")]


def fill_windows(tails: list[np.ndarray], window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start in its tail, length); every token lies in exactly one piece."""
    index = Neighbours(tails)
    sizes = np.array([len(t) for t in tails], np.int64)
    unused = sizes > 0
    sequences: list[list[tuple[int, int, int]]] = []
    seeds = iter(np.argsort(-sizes, kind="stable"))
    rest: tuple[int, int] | None = None  # a cut document and where its rest starts
    while True:
        if rest is None:
            seed = next((int(d) for d in seeds if unused[d]), None)
            if seed is None:
                break
            unused[seed] = False
            rest = (seed, 0)
        doc, start = rest
        rest = None
        filled = [(doc, start, int(sizes[doc] - start))]
        space = window - filled[0][2]
        if space:
            ranked = index.ranked(doc, unused)
            lengths = sizes[ranked]
            at = 0
            while space and at < len(ranked):
                fits = np.flatnonzero(lengths[at:] <= space)
                if not len(fits):
                    break
                at += int(fits[0])
                d = int(ranked[at])
                filled.append((d, 0, int(sizes[d])))
                unused[d] = False
                space -= int(sizes[d])
                at += 1
            if space:
                cut = next((int(d) for d in ranked if unused[d]), None)
                if cut is not None:  # longer than the space left, or it would have fitted
                    unused[cut] = False
                    filled.append((cut, 0, space))
                    rest = (cut, space)
                    space = 0
        sequences.extend(_powers(filled) if space else [filled])
    return sequences


def _powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces cut into sequences whose lengths are powers of two, longest first."""
    out: list[list[tuple[int, int, int]]] = []
    queue = list(reversed(pieces))
    total = sum(p[2] for p in pieces)
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        sequence = []
        while size:
            doc, start, length = queue.pop()
            used = min(length, size)
            sequence.append((doc, start, used))
            size -= used
            if used < length:
                queue.append((doc, start + used, length - used))
        out.append(sequence)
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _counted(batches: Iterable[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """In how many tails each term stands."""
    counts = np.zeros(0, np.int64)
    for batch in batches:
        for tail in batch.column("tail").to_pylist():
            terms = np.unique(np.frombuffer(tail, kind))
            if len(terms) and terms[-1] >= len(counts):
                counts = np.append(counts, np.zeros(int(terms[-1]) + 1, np.int64))
            counts[terms] += 1
    terms = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(counts[terms])], ["term", "n"])


def rarity(counts: dict[int, int]) -> np.ndarray:
    """Rank of each term, the rarest of several tails first; terms of one tail alone have the last rank."""
    terms, n = np.array(list(counts), np.int64), np.array(list(counts.values()), np.int64)
    ranks = np.full(int(terms.max()) + 1 if len(terms) else 1, 0xFFFFFFFF, np.uint32)
    terms, n = terms[n > 1], n[n > 1]
    ranks[terms[np.lexsort((terms, n))]] = np.arange(len(terms))
    return ranks


def rarest(tail: bytes, ranks: np.ndarray, kind: str) -> np.ndarray:
    """Ranks of a tail's rarest terms that other tails hold, too, in order."""
    own = np.unique(ranks[np.frombuffer(tail, kind)])[:KEY_TERMS]
    return own[own < 0xFFFFFFFF].astype(np.uint64)


NO_TERM = 0xFFFFFFFF
_FIRST, _SECOND = np.triu_indices(KEY_TERMS, 1)  # places of all pairs of terms, rarest first


def _rare(batches: Iterable[pa.RecordBatch], ranks, kind: str) -> Iterator[pa.RecordBatch]:
    """The rows with ``own``: ranks of their rarest terms in several tails, filled up to ``KEY_TERMS``."""
    for batch in batches:
        own = np.full((batch.num_rows, KEY_TERMS), NO_TERM, np.uint32)
        for i, tail in enumerate(batch.column("tail").to_pylist()):
            found = rarest(tail, ranks.value, kind)
            own[i, : len(found)] = found
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in own], pa.binary())], [*batch.schema.names, "own"])


def _own(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("own").to_pylist()), np.uint32).reshape(-1, KEY_TERMS)


def _pairs(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each pair of terms of each row, and whether the pair is one."""
    numbers = mixed((own[:, _FIRST].astype(np.uint64) << np.uint64(32)) | own[:, _SECOND]).view(np.int64)
    return numbers, own[:, _SECOND] != NO_TERM


def _listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        numbers, real = _pairs(_own(batch))
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(numbers[real])], ["pair"])


def _keyed(batches: Iterable[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """The rows with ``terms``: ranks of the rarest pair of terms in several tails, then of the others, so that they sort."""
    for batch in batches:
        own = _own(batch)
        numbers, real = _pairs(own)
        hit = real & in_bit_map(shared.value, numbers)
        best = hit.argmax(1)
        paired = hit[np.arange(len(own)), best]
        places = np.arange(KEY_TERMS)[None, :].repeat(len(own), 0)
        first, second = _FIRST[best][:, None], _SECOND[best][:, None]
        order = np.where(paired[:, None], np.where(places == first, -2, np.where(places == second, -1, places)), places)
        keys = np.take_along_axis(own, np.argsort(order, 1, kind="stable"), 1).astype(">u4")
        names = [n for n in batch.schema.names if n != "own"]
        yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array([k.tobytes() for k in keys], pa.binary())], [*names, "terms"])


def cut_at(keys: list[bytes], mean: int) -> int:
    """How many of the first rows, about ``mean``, make a shard: where two rows share least of their keys."""
    def shared(i: int) -> int:
        return next((k for k in range(KEY_TERMS) if keys[i - 1][4 * k : 4 * k + 4] != keys[i][4 * k : 4 * k + 4]), KEY_TERMS)

    if len(keys) <= mean + mean // 2:
        return len(keys)
    return min(range(max(1, mean // 2), mean + mean // 2 + 1), key=lambda i: (shared(i), abs(i - mean)))


def _sharded(batches: Iterable[pa.RecordBatch], window: int, kind: str, shard_docs: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows cut into shards, each packed for itself."""
    number, held = TaskContext.get().partitionId() << 44, None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        keys, at = held.column("terms").to_pylist(), 0
        while held.num_rows - at >= 2 * shard_docs:
            size = cut_at(keys[at : at + 2 * shard_docs], shard_docs)
            yield _packed(held.slice(at, size), number, window, kind)
            number, at = number + (1 << 24), at + size
        held = held.slice(at).combine_chunks()
    keys, at = held.column("terms").to_pylist() if held is not None else [], 0
    while at < len(keys):
        size = cut_at(keys[at:], shard_docs)
        yield _packed(held.slice(at, size), number, window, kind)
        number, at = number + (1 << 24), at + size


def _packed(shard: pa.Table, number: int, window: int, kind: str) -> pa.RecordBatch:
    found = list(zip(*[shard.column(c).to_pylist() for c in ("doc_id", "n_tokens", "crcs", "tail")], strict=True))
    found.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1], zlib.crc32(x[3])))
    ids, tokens = [x[0] for x in found], [x[1] for x in found]
    rows: list[tuple] = []
    for doc, n, crcs, _ in found:
        for k, crc in enumerate(crcs):
            rows.append((doc, k * window, window, int(crc), n, number, 0))
            number += 1
    tails = [np.frombuffer(x[3], kind) for x in found]
    for sequence in fill_windows(tails, window):
        offset = 0
        for d, start, length in sequence:
            before = tokens[d] - len(tails[d])
            rows.append((ids[d], before + start, length, _crc(tails[d][start : start + length]), tokens[d], number, offset))
            offset += length
        number += 1
    names = [x.split()[0] for x in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names)


def pack(
    docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` tokens.

    Returns doc_id, start (the document's ids before the piece), length, ids_crc32 (of the little-endian 32-bit
    ids), doc_tokens, sequence_id and offset in the sequence.  ``tokenizer`` is the path of a tokenizer file that
    every executor can read; ``window`` must be a power of two.
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    path = tokenizer or default_tokenizer()
    kind = word_ids(path).kind.str
    rows = docs.select(
        F.xxhash64(F.col("doc_id"), F.monotonically_increasing_id()).alias("salt"), F.col("doc_id").cast("long").alias("doc_id"), "text",
    )
    fields = "salt long, doc_id long, n_tokens long, crcs array<long>, tail binary"
    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        tokenised = cut_lineage(rows.mapInArrow(lambda batches: _tokenised(batches, path, window, end_id), fields))
    # as many counts as the tokenizer has ids
    counts = tokenised.select("tail").mapInArrow(lambda batches: _counted(batches, kind), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    ranks = docs.sparkSession.sparkContext.broadcast(rarity({r.term: r.n for r in counts.collect()}))
    # kept, since three later passes read it (pairs, the sample that the range sort draws, the sort itself)
    rare = cut_lineage(tokenised.mapInArrow(lambda batches: _rare(batches, ranks, kind), f"{fields}, own binary"))
    pairs = rare.select("own").mapInArrow(_listed, "pair long")
    shared = bit_map(pairs.groupBy("pair").count().filter("count > 1").select("pair"), "pair", PAIR_BITS)
    keyed = rare.mapInArrow(lambda batches: _keyed(batches, shared), f"{fields}, terms binary")
    # rows of one key are many where texts are copies, so the salt lets them be cut
    dealt = keyed.repartitionByRange("terms", "salt").sortWithinPartitions("terms", "salt")
    return dealt.mapInArrow(lambda batches: _sharded(batches, window, kind, shard_docs), PIECES)
