"""Quality votes, pipelined lexical search and the prefix trie against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vulnlake.llm import lexical_search, prefix_trie, quality_votes, sorted_runs

DOCS = "doc_id long, text string"


# ---- running values over sorted parts


def test_running_values_when_a_key_fills_many_parts(spark):
    random.seed(3)
    rows = [(random.choice([1, 2, 2, 2, 2, 2, 9]), i, random.randrange(-(1 << 62), 1 << 62)) for i in range(4000)]
    df = spark.createDataFrame(rows, "k long, i long, v long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = sorted_runs.sorted_parts(df, ["k", "i"])
        assert parts.select(sorted_runs.SLICE).distinct().count() > 2
        got = {(r.k, r.i): (r.n, r.x, r.before) for r in sorted_runs.previous(
            sorted_runs.running(parts.withColumn("one", F.lit(1).cast("long")), "k", {"n": ("one", "sum"), "x": ("v", "xor")}), "k", "i", "before").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    n, x, before = Counter(), Counter(), {}
    for k, i, v in sorted(rows):
        n[k] += 1
        x[k] ^= v
        assert got[k, i] == (n[k], x[k], before.get(k))
        before[k] = i


# ---- quality votes


def _prose(r, n):
    return " ".join(r.choice(["river", "stone", "house", "walks", "under", "bridge", "light", "again", "never"]) + r.choice(["", "", ","]) for _ in range(n))


def _junk(r, n):
    kind = r.randrange(3)
    if kind == 0:
        return " ".join(w + r.choice(["###", "%%%"]) for w in _prose(r, n).split())
    if kind == 1:
        return " ".join([r.choice(["stone", "bridge"])] * n)
    return " ".join(w.upper() + "!!" for w in _prose(r, n).split())


def test_votes_on_held_out_rows(spark):
    r = random.Random(1)
    docs = [(i, (_junk if i % 5 == 3 else _prose)(r, r.randrange(5, 200))) for i in range(600)]
    labels = [(i, int(i % 5 != 3), 0) for i in range(600)]
    got = quality_votes.classify(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 600
    for row in got:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0)
        assert 0 <= row.score <= 1 and row.predicted == int(row.score >= 0.3)
    held = [row for row in got if row.held_out]
    assert np.mean([row.predicted == int(row.doc_id % 5 != 3) for row in held]) > 0.97


def test_held_out_labels_are_never_read(spark):
    r = random.Random(2)
    docs = spark.createDataFrame([(i, (_junk if i % 4 == 1 else _prose)(r, 40)) for i in range(200)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 != 1), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    wrong = labels.withColumn("quality", F.when(quality_votes.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    first, second = ({x.doc_id: x.score for x in quality_votes.classify(docs, y).collect()} for y in (labels, wrong))
    assert first == second


def test_votes_are_those_of_all_labelled_vectors():
    """The blocked products find the same neighbours as one comparison after the other."""
    r = random.Random(4)
    texts = [(_junk if i % 3 == 0 else _prose)(r, r.randrange(3, 60)) for i in range(700)]
    counts = np.concatenate([b for _, b in quality_votes.term_counts(pa.array(texts))])
    voters = quality_votes.fit_voters(counts[:300].astype(np.float32), [int(i % 3 != 0) for i in range(300)], neighbours=7)
    blocked = voters.vote(counts[300:])
    for at, vector in enumerate(voters.project(counts[300:])):
        near = sorted(((float(vector @ v), int(y)) for v, y in zip(voters.vectors, voters.labels, strict=True)), key=lambda p: -p[0])
        if near[6][0] - near[7][0] < 1e-5:
            continue  # a tie at the last place
        total = sum(max(c, 0) for c, _ in near[:7])
        assert blocked[at] == pytest.approx(sum(max(c, 0) * y for c, y in near[:7]) / total, abs=1e-4)


def test_words_shapes_and_echoes_are_counted():
    def places(text):
        return Counter(quality_votes.term_places(pa.array([text]))[1].tolist())

    assert places("House") != places("house") and len(places("a") & places("A")) == 1  # one word, two shapes
    assert places("no no no")[quality_votes.DIMENSIONS - 1] == 2 and places("no no no")[quality_votes.DIMENSIONS - 2] == 1
    assert places("abcd,") & places("xy,") and places("") == Counter() and places(" \n") == Counter()


def test_strange_rows_get_votes(spark):
    r = random.Random(5)
    rows = [(i, (_junk if i % 2 else _prose)(r, 20), "en", 1) for i in range(40)] + [
        (None, "river stone", "en", 2), (50, None, None, 3), (51, "", "en", 4), (52, "\t \n", "x", 5), (3, _junk(r, 20), "en", 6), (53, "word " * 200_000, "en", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, `score` int").withColumnRenamed("lang", "a.b")
    labels = spark.createDataFrame([(i, i % 2 ^ 1, 0) for i in range(40)] + [(3, 0, 0), (None, 1, 0), (50, None, 0), (51, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality_votes.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    empty = {x.score for x in got if x.doc_id in (50, 51, 52)}
    assert len(empty) == 1 and 0 < empty.pop() < 1
    none = quality_votes.classify(docs, labels.limit(0))
    assert {x.score for x in none.collect()} == {0.5}
    assert quality_votes.classify(docs.limit(0), labels).count() == 0


# ---- lexical search


def brute_search(docs, items, k=50):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counted = [(i, Counter(term.findall((t or "").translate(lower)))) for i, t in docs]
    counted = [(i, c, c.total()) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(w for _, c, _ in counted for w in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(term.findall((t or "").translate(lower)))
    out = []
    for item, words in asked.items():
        scored = []
        for i, c, n in counted:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 20 * m)) for w in words if w in c)
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def _texts(r, n, vocabulary):
    weights = [1 / (j + 1) for j in range(len(vocabulary))]
    return [" ".join(r.choices(vocabulary, weights, k=r.choice([1, 3, 10, 40, 300]))) for _ in range(n)]


@pytest.mark.parametrize(("bundle", "limit"), [(256, 16 << 20), (3, 2000)])
def test_search_equals_brute_force(spark, rows, bundle, limit):
    r = random.Random(7)
    vocabulary = [f"w{j}" if j % 7 else f"Wört{j}" for j in range(300)]
    texts = _texts(r, 400, vocabulary)
    docs = [(i, t.replace(" ", r.choice([" ", "-", "\n", "_"]))) for i, t in enumerate(texts)] + [(i, texts[0]) for i in range(1000, 1120)]
    items = [(i, t) for i, t in enumerate(_texts(r, 20, vocabulary))] + [(90, texts[0]), (91, "w0 W0 wÖrt7"), (92, "none of these"), (93, " ".join(vocabulary))]
    got = lexical_search.search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string"), bundle=bundle, limit=limit)
    assert rows(got, "item_id", "rank", "doc_id", "score") == brute_search(docs, items)


def test_stages_drop_only_what_cannot_count(spark, rows):
    """Short lists: thresholds close early, later owners add to kept accumulators alone."""
    r = random.Random(8)
    vocabulary = [f"w{j}" for j in range(2000)]
    texts = _texts(r, 1500, vocabulary)
    docs, items = list(enumerate(texts)), [(i, " ".join(r.sample(t.split(), min(12, len(t.split()))))) for i, t in enumerate(r.sample(texts, 15))]
    for k in (1, 5):
        got = lexical_search.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), k=k, limit=30_000)
        assert rows(got, "item_id", "rank", "doc_id", "score") == brute_search(docs, items, k)


def test_strange_rows_are_searched(spark, rows):
    docs = [(None, "alpha beta"), (1, None), (2, ""), (3, "..."), (4, "Alpha ALPHA alpha"), (4, "Alpha ALPHA alpha"), (5, "alpha " * 100_000 + "beta"), (6, "gamma\x00delta")]
    items = [(None, "alpha"), (None, "beta"), (1, None), (2, ""), (3, "beta delta"), (3, "gamma"), (3, "gamma")]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], DOCS + ", score int, block int").withColumnRenamed("score", "a.b")
    asked = spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, term int")
    assert rows(lexical_search.search(frame, asked), "item_id", "rank", "doc_id", "score") == brute_search(docs, items)
    assert lexical_search.search(frame.limit(0), asked).count() == 0
    assert lexical_search.search(frame, asked.limit(0)).count() == 0


# ---- prefix trie


def brute_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        start = c - int(math.fmod(c, 5))
        whole[c] = turns.get(start, [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, cs in members.items():
        size = (len(cs) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += size
    return sorted(((
        min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], leaves[p], saved[p],
        hashlib.sha256(",".join(str(c) for c in sorted(c for c in cs if len(whole[c]) == len(p))).encode()).hexdigest(),
    ) for p, cs in members.items()), key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("finish", [8192, 3])
def test_trie_equals_brute_force(spark, rows, finish):
    r = random.Random(9)
    table = [(c, t, r.choice(["user", "assistant"]), r.choice(["hi", "yes", "größe", "", "long text " * 9])) for c in range(-23, 60) if c % 11 for t in range(r.randrange(1, 14))]
    table += [(c, 0, "user", "hi") for c in range(100, 160)]  # many children and copies under the root
    table += [(400, t, "user", f"{t % 3}") for t in range(300)] + [(401, t, "user", f"{t % 3}") for t in range(280)]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows(prefix_trie.prefix_trie(df, finish), *COLUMNS)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute_trie(table)


def test_strange_turns_make_a_trie(spark, rows):
    table = [(1, None, None, None), (1, 3, "user", None), (1, 3, "user", "b"), (1, 3, "user", "b"), (1, 3, "assistant", "a"), (2, 0, "user", "x" * 100_000),
             (None, 0, "user", "lost"), (7, 0, "", ""), (7, None, "user", ""), (10, 5, "user", "ab"), (10, -5, "use", "rab"), (-5, 0, "u", "t"), (-3, 0, "u", "t"), (-3, 1, "u", "t")]
    df = spark.createDataFrame([(*x, 1, 2) for x in table], "conv_id long, turn long, role string, text string, depth int, pos int").withColumnRenamed("pos", "a.b")
    assert rows(prefix_trie.prefix_trie(df), *COLUMNS) == brute_trie(table)
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0


def test_turnless_conversations_end_at_the_root(spark, rows):
    lost = [c for c in range(1, 2000) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2][:40]  # their first conversation is absent
    table = [(c, 0, "user", "one") for c in lost]
    got = rows(prefix_trie.prefix_trie(spark.createDataFrame(table, "conv_id long, turn long, role string, text string")), *COLUMNS)
    assert got == brute_trie(table) and len(got) == 1 and got[0][3] == 40
