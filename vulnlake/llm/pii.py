"""Personal data by weak supervision.

Candidate spans come from patterns (email, ip, card, phone), assignments of secrets, honorific names and
digit groups.  Five labelers vote on each candidate (yes, no, or no opinion): the pattern with its own
arithmetic check, a gazetteer, the words before it, the words after it, and its shape.  Expectation-maximisation
estimates how reliable each labeler is per kind from the counts of vote patterns alone, and gives every pattern
a probability of being personal data.  Those probabilities train the final span classifier, a logistic
regression over the votes and context of a candidate.  Spans of the base patterns are always kept; the
classifier decides on the others.

Both models see the whole corpus through counts: the number of distinct (kind, votes, context) combinations is
fixed, so what is brought together does not grow with the input.  Every expression is linear in the text.

Null and empty texts hold nothing; the empty table trains no model and gives no row; repeated rows are
annotated each for itself; ties between overlapping spans go to the base kinds, then to the earlier start.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import pieces, plain_names, texts_of

BASE = ("email", "ip", "card", "phone")
EXTRA = ("id_number", "name", "secret")
KINDS = (*BASE, *EXTRA)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never starts inside a run of digits: its first digit would have matched, too
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SECRET = re.compile(r"""(?i)(?<![A-Za-z0-9_])(api[_-]?key|access[_-]?key|secret|token|passwd|password|auth)\s?[:=]\s?["']?([A-Za-z0-9+/_.-]{8,}+)""")
NAME = re.compile(r"(?<![^\W_])(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sr|Sra)\.? (?:[A-Z][a-zà-ÿ]{1,30})(?: [A-Z][a-zà-ÿ]{1,30}){0,2}")
ID_NUMBER = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
WORDS = re.compile(r"[^\W\d_]+")

#: Gazetteers and context words; parameters of the labelers.
GIVEN_NAMES = frozenset("james mary robert patricia john jennifer michael linda david elizabeth maria anna peter hans juan jose marie jean pierre claire carlos lucia thomas laura".split())
DOMAIN_ENDS = frozenset("com org net edu gov info io de fr es uk eu".split())
CUES = {
    "email": frozenset("mail email contact write to send".split()), "ip": frozenset("ip host server address from login".split()),
    "card": frozenset("card visa credit debit payment mastercard".split()), "phone": frozenset("call phone tel telephone mobile fax".split()),
    "id_number": frozenset("ssn social security id number".split()), "name": frozenset("dear by from signed name".split()),
    "secret": frozenset("key secret token password login credentials".split()),
}
LABELERS = 5


class Candidate(NamedTuple):
    kind: int
    start: int
    end: int
    votes: tuple[int, ...]  # of each labeler: 0 no opinion, 1 yes, 2 no
    context: int
    base: bool

    def code(self) -> int:
        votes = 0
        for v in self.votes:
            votes = votes * 3 + v
        return (self.kind * 3**LABELERS + votes) * 16 + self.context


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards in linear time."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        else:
            free = at + 1
        at = text.find("@", max(free, at + 1))


def ips(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in IP.finditer(text):
        parts = m.group().split(".")
        yield m.start(), m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def cards(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "") if not m.group().isdigit() else m.group()
        if len(digits) >= 9:
            yield m.start(), m.end(), 13 <= len(digits) <= 19 and luhn(digits)


def phones(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in PHONE.finditer(text):
        yield m.start(), m.end(), 9 <= sum(c.isdigit() for c in m.group()) <= 15


def _sides(text: str, start: int, end: int) -> tuple[set[str], set[str]]:
    before = WORDS.findall(text[max(0, start - 40) : start].lower())
    after = WORDS.findall(text[end : end + 25].lower())
    return set(before[-4:]), set(after[:2])


def candidates(text: str) -> list[Candidate]:
    """All candidate spans of a text, with the labelers' votes; ``base`` marks those of the base patterns."""
    found: list[tuple[int, int, int, bool, bool]] = []  # kind, start, end, passes its check, base
    if "@" in text:
        found += [(0, s, e, True, True) for s, e in emails(text)]
    found += [(1, s, e, ok, ok) for s, e, ok in ips(text)]
    found += [(2, s, e, ok, ok) for s, e, ok in cards(text)]
    if "+" in text:
        found += [(3, s, e, ok, ok) for s, e, ok in phones(text)]
    if "-" in text:
        found += [(4, m.start(), m.end(), m.group()[:3] not in ("000", "666") and m.group()[0] != "9", False) for m in ID_NUMBER.finditer(text)]
    found += [(5, m.start(), m.end(), True, False) for m in NAME.finditer(text)]
    if "=" in text or ":" in text:
        found += [(6, m.start(2), m.end(2), any(c.isdigit() for c in m.group(2)), False) for m in SECRET.finditer(text)]
    out = []
    for kind, start, end, passes, base in found:
        span = text[start:end]
        before, after = _sides(text, start, end)
        name = KINDS[kind]
        if name == "name":
            listed = 1 if set(WORDS.findall(span.lower())) & GIVEN_NAMES else 0
        elif name == "email":
            listed = 1 if span.rsplit(".", 1)[-1].lower() in DOMAIN_ENDS else 2
        else:
            listed = 0
        cue = 1 if before & CUES[name] else 0
        later = 1 if after & CUES[name] else 0
        alone = (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum())
        shape = 1 if alone and 6 <= len(span) and (len(span) <= 80 or name == "secret") else 2
        context = (len(span) > 12) | (any(c.isdigit() for c in span) << 1) | ((start > 0 and text[start - 1] == "\n") << 2) | (alone << 3)
        out.append(Candidate(kind, start, end, (1 if passes else 2, listed, cue, later, shape), int(context), base))
    return out


@dataclass(frozen=True)
class Model:
    """Codes (kind, votes, context) of candidates that count, and the estimated reliabilities."""

    accepted: frozenset[int]
    reliability: np.ndarray  # kind, truth, labeler, vote
    prior: np.ndarray


def estimate(counts: dict[int, int], rounds: int = 50) -> tuple[np.ndarray, np.ndarray, dict[int, float]]:
    """Dawid-Skene by expectation-maximisation over weighted vote patterns, one model per kind."""
    reliability = np.full((len(KINDS), 2, LABELERS, 3), 1 / 3)
    prior = np.full(len(KINDS), 0.5)
    belief: dict[int, float] = {}
    per_kind: dict[int, list[tuple[int, np.ndarray, int]]] = {}
    for code, n in sorted(counts.items()):
        pattern, kind = code // 16 % 3**LABELERS, code // 16 // 3**LABELERS
        votes = np.array([pattern // 3 ** (LABELERS - 1 - j) % 3 for j in range(LABELERS)])
        per_kind.setdefault(kind, []).append((code, votes, n))
    for kind, rows in per_kind.items():
        votes = np.stack([v for _, v, _ in rows])
        n = np.array([w for _, _, w in rows], float)
        yes, no = (votes == 1).sum(1), (votes == 2).sum(1)
        checked = votes[:, 0] == 1  # start: share of yes among the opinions, the pattern's own check counting threefold
        p = (yes + 2 * checked + 0.5) / (yes + no + 3.0)
        for _ in range(rounds):
            for truth, weight in ((1, p * n), (0, (1 - p) * n)):
                for j in range(LABELERS):
                    seen = np.bincount(votes[:, j], weights=weight, minlength=3)
                    # until the data say otherwise, a labeler votes as it does overall, a little better than chance
                    overall = np.bincount(votes[:, j], weights=n, minlength=3) / n.sum()
                    hold = 4 * overall + (np.array([0.1, 0.2, 0.1]) if truth else np.array([0.1, 0.1, 0.2]))
                    if j == 0:  # the pattern's own check is known to be a strong one
                        hold = hold + n.sum() * np.array([0.0, 0.95, 0.05] if truth else [0.0, 0.1, 0.9])
                    reliability[kind, truth, j] = (seen + hold) / (seen + hold).sum()
            prior[kind] = ((p * n).sum() + 1) / (n.sum() + 2)
            log = [np.log(w) + np.log(reliability[kind, t][np.arange(LABELERS), votes]).sum(1) for t, w in ((0, 1 - prior[kind]), (1, prior[kind]))]
            new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
            if np.abs(new - p).max() < 1e-9:
                break
            p = new
        belief |= {code: float(x) for (code, _, _), x in zip(rows, p, strict=True)}
    return reliability, prior, belief


def fit(counts: dict[int, int], threshold: float = 0.5, l2: float = 0.02) -> Model:
    """The span classifier, trained on the probabilities that the labelers' model gives."""
    reliability, prior, belief = estimate(counts)
    codes = sorted(counts)
    if not codes:
        return Model(frozenset(), reliability, prior)
    rows = []
    for code in codes:
        context, pattern, kind = code % 16, code // 16 % 3**LABELERS, code // 16 // 3**LABELERS
        votes = [pattern // 3 ** (LABELERS - 1 - j) % 3 for j in range(LABELERS)]
        rows.append([float(kind == k) for k in range(len(KINDS))] + [float(v == w) for v in votes for w in (1, 2)] + [float(context >> b & 1) for b in range(4)])
    x, y = np.array(rows), np.array([belief[c] for c in codes])
    n = np.sqrt(np.array([counts[c] for c in codes], float))  # frequent combinations count more, but do not drown the rest
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w)), x.T @ (n * (p - y)) + l2 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
    return Model(frozenset(c for c, q in zip(codes, p, strict=True) if q >= threshold), reliability, prior)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, int] = {}
    for batch in pieces(batches, "text"):
        for text in texts_of(batch.column("text")):
            for c in candidates(text):
                counts[c.code()] = counts.get(c.code(), 0) + 1
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["code", "n"])


def train(docs: DataFrame, threshold: float = 0.5) -> Model:
    """Estimate reliabilities and fit the classifier on vote counts of all documents."""
    counts = docs.select("text").mapInArrow(_counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return fit({r.code: r.n for r in counts.collect()}, threshold)


def spans_of(text: str, model: Model) -> list[Candidate]:
    """Base spans and accepted others, by kind, then start; others never overlap a kept span."""
    found = candidates(text)
    kept = [c for c in found if c.base]
    starts, ends = [], []  # the base spans' union
    for c in sorted(kept, key=lambda c: c.start):
        if ends and c.start <= ends[-1]:
            ends[-1] = max(ends[-1], c.end)
        else:
            starts.append(c.start)
            ends.append(c.end)
    free = 0
    for c in sorted((c for c in found if not c.base and c.code() in model.accepted), key=lambda c: (c.start, c.kind)):
        at = bisect_right(ends, c.start)  # the first base span that ends behind the candidate's start
        if c.start >= free and (at == len(starts) or starts[at] >= c.end):
            kept.append(c)
            free = c.end
    return sorted(kept, key=lambda c: (c.kind, c.start))


def _listed(spans: Sequence[Candidate]) -> str:
    return ",".join(f"{KINDS[c.kind]}:{c.start}:{c.end}" for c in spans)


def _annotated(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[] for _ in range(6)]
        for text in texts_of(batch.column("text")):
            spans = spans_of(text, model)
            base = [c for c in spans if c.base]
            for k in range(4):
                columns[k].append(sum(c.kind == k for c in base))
            columns[4].append(hashlib.sha256(_listed(base).encode()).hexdigest())
            columns[5].append(_listed(spans))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:4]], *[pa.array(c, pa.string()) for c in columns[4:]]],
            ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
        )


def annotate(docs: DataFrame, model: Model | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans and all spans of every document."""
    model = model or train(docs, threshold)
    rows = docs.select("doc_id", "text")
    fields = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return rows.mapInArrow(lambda batches: _annotated(batches, model), f"doc_id {rows.dtypes[0][1]}, {fields}")


def redact(text: str, model: Model) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for c in sorted(spans_of(text, model), key=lambda c: (c.start, -c.end)):
        if c.end <= at:
            continue
        if c.start >= at:
            out += [text[at : c.start], f"<{KINDS[c.kind]}>"]
        at = c.end
    return "".join(out) + text[at:]


def _redacted(batches: Iterable[pa.RecordBatch], model: Model, at: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, f"c{at}"):
        new = pa.array([x if x is None else redact(x, model) for x in batch.column(at).to_pylist()], pa.string())
        yield batch.set_column(at, batch.schema.field(at).name, new)


def redacted_documents(docs: DataFrame, model: Model | None = None, threshold: float = 0.5) -> DataFrame:
    """All documents, personal data replaced in ``text`` (and ``n_chars`` recounted where that column exists)."""
    model = model or train(docs, threshold)
    names = list(docs.columns)
    plain, at = plain_names(docs), names.index("text")
    out = plain.mapInArrow(lambda batches: _redacted(batches, model, at), plain.schema)
    if "n_chars" in names:
        out = out.withColumn(f"c{names.index('n_chars')}", F.length(f"c{at}").cast(dict(docs.dtypes)["n_chars"]))
    return out.toDF(*names)
