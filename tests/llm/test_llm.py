"""Each operator against a plain counterpart, and on nulls, empties, ties, repeats, long texts and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vulnlake.llm import jaccard_join, licenses, mixing, neighbours, packing, passages, pii, quality, substrings, toxicity

FIELDS = "doc_id long, text string, lang string, source string, n_chars int, `set` int, size string, `key` int, n string, sig int, target int"


def frame(spark, texts, sources=None, first=0):
    rows = [
        (first + i, t, "en", sources[i] if sources else "a", len(t or ""), 1, "x", 2, "y", 3, 4) for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, FIELDS)


def prose(n, seed):
    rng = random.Random(seed)
    return [" ".join("w" + str(rng.randrange(4000)) for _ in range(rng.randint(30, 120))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Prose with exact copies, near copies, shared passages and oddities."""
    rng = random.Random(5)
    texts = prose(24, 1)
    passage = " ".join("p" + str(rng.randrange(4000)) for _ in range(70))
    texts += [texts[0], texts[1], texts[1]]
    near = texts[2].split()
    near[len(near) // 2] = "changed"
    texts += [" ".join(near), texts[3] + " " + passage, passage + "\n" + texts[4], texts[5].upper()]
    return texts + ["", " \t\n", "one two", "One  two", "ä é 中文 " * 40, "same " * 60, None]


def strange(spark):
    """Null ids, texts and sources, repeated rows, ties and one very long text."""
    long = " ".join("v" + str(i % 977) for i in range(30_000))
    rows = [
        (None, "a b c d e f g", "en", None, 1), (None, None, None, "s", None), (1, None, "en", "s", 0), (2, "", None, "s", 0),
        (3, "x y z", "en", None, 5), (3, "x y z", "en", None, 5), (4, "mit license", "en", "s", 3), (5, long, "en", "t", 9),
        (6, long, "en", "t", 9), (7, "tail a@b.co", "de", "t", 4),
    ]
    more = [r + (1, "x", 2, "y", 3, 4) for r in rows]
    return spark.createDataFrame(more, FIELDS)


def results(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    return {
        "substrings": substrings.deduplicated(docs), "jaccard": jaccard_join.similar_documents(docs),
        "survivors": jaccard_join.one_per_component(docs), "licenses": licenses.scan(docs), "mix": mixing.mix(docs),
        "mixed": mixing.mixed_documents(docs), "pii": pii.annotate(docs), "redacted": pii.redacted_documents(docs),
        "passages": passages.repeated_passages(docs), "toxicity": toxicity.classify(docs, labels),
        "clean": toxicity.clean_documents(docs, labels), "packing": packing.pack(docs), "quality": quality.judge(docs),
    }


def test_empty_tables(spark):
    for name, df in results(spark, frame(spark, []).filter("doc_id < 0")).items():
        assert df.count() == 0, name


def test_strange_rows(spark):
    docs = strange(spark)
    per_row = {"substrings", "jaccard", "licenses", "mix", "pii", "redacted", "toxicity", "quality"}
    for name, df in results(spark, docs).items():
        n = df.count()
        assert n == 10 if name in per_row else n > 0 or name == "passages", name
        if name in ("survivors", "mixed", "redacted", "clean"):
            assert df.columns == docs.columns


def test_substrings_against_brute_force(spark, corpus):
    seen, expected = set(), []
    for i, text in enumerate(corpus):
        data = (text or "").encode()
        mark = bytearray(len(data))
        for p in range(len(data) - 99):
            piece = data[p : p + 100]
            if piece in seen:
                mark[p : p + 100] = b"\1" * 100
            seen.add(piece)
        kept = bytes(c for c, m in zip(data, mark) if not m)
        spans = sum(1 for j, m in enumerate(mark) if m and not (j and mark[j - 1]))
        expected.append((i, len(data), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    got = substrings.deduplicated(frame(spark, corpus)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected
    assert any(r.n_removed for r in got)


def components(texts, percent=80):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))
    for _ in sets:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= percent * len(x | y):
                    root[i] = min(root[i], root[j])
    return [(i, len(s), root[i]) for i, s in enumerate(sets)]


def test_jaccard_join_against_all_pairs(spark, corpus):
    rng = random.Random(9)
    texts = list(corpus)
    # chains of near copies of all sizes, around the limit of the similarity
    for n in (3, 5, 6, 9, 13, 20, 60):
        base = ["b" + str(rng.randrange(10**6)) for _ in range(n + 4)]
        for k in range(8):
            words = list(base)
            for _ in range(k % 4):
                words[rng.randrange(len(words))] = "z" + str(rng.randrange(3))
            texts.append(" ".join(words[: len(words) - k // 4]))
    got = jaccard_join.similar_documents(frame(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == components(texts)


def test_large_groups_meet_by_their_differences(spark, monkeypatch):
    """With every group taken as a large one, the links stay the same."""
    monkeypatch.setattr(jaccard_join, "FEW", 0)
    rng = random.Random(2)
    base, texts = ["c" + str(i) for i in range(80)], []
    for _ in range(30):
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(80)] = "e" + str(rng.randrange(6))
        texts.append(" ".join(words))
    got = jaccard_join.similar_documents(frame(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == components(texts)


def test_one_document_of_each_component_stays(spark, corpus):
    kept = {r.doc_id for r in jaccard_join.one_per_component(frame(spark, corpus)).collect()}
    assert kept == {i for i, _, c in components(corpus) if i == c}


def test_license_phrases_and_templates(spark):
    texts = [
        "Released under the MIT License.", "an Apache-License and the MIT  license, mit LICENSE", "GNU General Public License v3",
        "Licensed under CC BY-NC 4.0.", "mit and license", "the unencumbered public", None,
    ]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, texts)).collect()}
    assert [got[i].n_base for i in range(7)] == [1, 3, 1, 0, 0, 0, 0]
    assert (got[1].first_word, got[1].last_word, got[1].base_labels) == (1, 7, "apache,mit")
    assert got[2].labels == "gpl" and got[2].first_word == 1
    assert got[3].labels == "cc-by-nc" and got[3].base_labels == "" and got[3].score > 0.6
    assert got[4].labels == got[5].labels == "" and got[4].score == 0 and got[4].first_word is None


def test_mix_keeps_to_its_targets(spark):
    texts = prose(300, 7)
    sources = [("a", "b", "c", None)[i % 7 % 4] for i in range(300)]
    docs = frame(spark, texts, sources)
    rows = mixing.mix(docs).collect()
    sizes = Counter()
    for t, s in zip(texts, sources):
        sizes[s] += len(t.split())
    weights = {"a": 3, "b": 1, "c": 2, None: 3}
    targets, left, free = {}, 1.5 * sum(sizes.values()), set(sizes)
    while True:  # reshare the excess until none is above its limit
        total = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / total > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            targets[s] = 2 * sizes[s]
            left -= targets[s]
            free.remove(s)
    targets |= {s: left * weights[s] / total for s in free}
    taken = Counter()
    for r in rows:
        assert r.taken in (0, r.size, 2 * r.size) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 60 for s in sizes)
    assert mixing.mixed_documents(docs).count() == sum(r.copies for r in rows)
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def plain_spans(text):
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and pii.luhn(digits):
            found.append(("card", m))
    found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return [(k, m.start(), m.end()) for k, m in found]


def test_personal_data_patterns_against_plain_ones():
    rng = random.Random(1)
    for i in range(4000):
        text = "".join(rng.choice("ab@@..--++% 0123456789 () \n_é" if i % 3 else "@.1234 -+") for _ in range(rng.randint(1, 60)))
        assert [(pii.KINDS[c.kind], c.start, c.end) for c in pii.candidates(text) if c.base] == plain_spans(text)
    for long in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "@" * 100_000, "+1 " * 60_000):
        pii.candidates(long)


def test_personal_data_query(spark):
    texts = [f"mail {i}@mail.example.com, host 10.0.0.{i}, token = \"a1b2c3d4e5{i}\", card 4417744280351547" for i in range(30)]
    texts += ["number 9807915762804490 here", "nothing", None]
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in pii.annotate(docs).collect()}
    listed = ",".join(f"{k}:{s}:{e}" for k, s, e in plain_spans(texts[3]))
    assert got[3].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
    assert (got[3].n_email, got[3].n_ip, got[3].n_card) == (1, 1, 1) and "secret:" in got[3].spans
    assert got[30].spans == "" and got[32].n_email == 0
    clean = {r.doc_id: r for r in pii.redacted_documents(docs).collect()}
    assert "@" not in clean[3].text and clean[31].text == "nothing" and clean[32].text is None
    assert clean[3].n_chars == len(clean[3].text)


def test_long_secrets_are_redacted_whole(spark):
    rng = random.Random(6)
    signs = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.-"
    secrets = ["".join(rng.choice(signs) for _ in range(999)) + "7" for _ in range(30)]
    texts = [f"the login token = \"{x}\" is a credential" for x in secrets] + ["a" * 100_000 + " token=" + "a1" * 50_000]
    texts += [f"token = \"a1b2c3d4e5{i}\"" for i in range(200)]  # short ones decide the shape
    docs = frame(spark, texts)
    clean = {r.doc_id: r.text for r in pii.redacted_documents(docs).collect()}
    assert all(x[-8:] not in clean[i] and x[300:308] not in clean[i] for i, x in enumerate(secrets))
    assert clean[0] == "the login token = \"<secret>\" is a credential"
    spans = [(c.start, c.end) for c in pii.candidates(texts[0]) if pii.KINDS[c.kind] == "secret"]
    assert spans == [(texts[0].index(secrets[0]), texts[0].index(secrets[0]) + 1000)]


def test_passages_shared_by_documents_are_found(spark, corpus):
    rows = passages.repeated_passages(frame(spark, corpus)).collect()
    seen, covered, got = {}, {}, {}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in enumerate(corpus):
        w = (t or "").translate(lower).split()
        for p in range(len(w) - 49):
            if seen.setdefault(tuple(w[p : p + 50]), i) != i:
                covered.setdefault(i, set()).update(range(p, p + 50))
    for r in rows:
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        assert r.similarity >= 0.8
    assert covered and all(c <= got.get(i, set()) for i, c in covered.items())


def test_passages_with_a_changed_word_at_every_place():
    def near(x, y, least, similar):  # brute force: is there any pair of stretches
        for a0, a1 in ((i, j) for i in range(len(x)) for j in range(i + least, len(x) + 1)):
            for b0, b1 in ((i, j) for i in range(len(y)) for j in range(i + least, len(y) + 1)):
                one, two = set(x[a0:a1]), set(y[b0:b1])
                if len(one & two) >= similar * len(one | two):
                    return True
        return False

    whole = np.arange(75, dtype=np.uint32)
    for place in range(79):  # a word stands in up to five shingles
        copy = whole.copy()
        copy[max(0, place - 4) : place + 1] += 1000
        found = passages.compare(whole, copy, 46, 0.8)
        assert found and found[0][1] - found[0][0] >= 70 and found[0][4] >= 0.8
    every45 = whole[:74].copy()
    every45[:4], every45[44:49] = every45[:4] + 1000, every45[44:49] + 1000
    assert passages.compare(whole[:74], every45, 46, 0.8)
    rng = np.random.default_rng(5)
    seen = set()
    for _ in range(150):
        x = rng.integers(0, 25, 14).astype(np.uint32)  # some shingles repeat
        y = np.roll(np.where(rng.random(14) < 0.2, rng.integers(50, 90, 14), x), rng.integers(0, 4)).astype(np.uint32)
        found = passages.compare(x, y, 8, 0.8)
        assert bool(found) == near(x.tolist(), y.tolist(), 8, 0.8)
        for a0, a1, b0, b1, share in found:
            one, two = set(x[a0:a1].tolist()), set(y[b0:b1].tolist())
            assert min(a1 - a0, b1 - b0) >= 8 and share == pytest.approx(len(one & two) / len(one | two)) and share >= 0.8
        seen.add(bool(found))
    assert seen == {True, False}


def test_passages_behind_unrelated_windows_of_a_group(spark):
    rng = random.Random(8)
    word = lambda: "v" + str(rng.randrange(10**9))
    # a text of 51 words has two stretches of 46 shingles; the phrase in its middle is the smallest shingle of both
    words = [word() for _ in range(400_000)]
    tokens = passages.shingle_hashes(pa.array([" ".join(words)]), 5)[0]
    values = [passages.mixed(tokens ^ np.uint64(0xA24BAED4963EE407 * (s + 1) & 0xFFFFFFFFFFFFFFFF)) for s in (0, 1)]
    at = int(np.maximum(*values).argmin())
    texts = [[word() for _ in range(23)] + words[at : at + 5] + [word() for _ in range(23)] for _ in range(30)]
    near = [t[:2] + [word()] + t[3:] for t in texts]
    docs = frame(spark, [" ".join(t) for t in [*texts, *texts, *near]])
    got = {(r.doc_id, r.first_doc) for r in passages.repeated_passages(docs).collect()}
    assert {(30 + i, i) for i in range(30)} <= got
    assert {(60 + i, i) for i in range(30)} <= got


def test_passages_of_repeating_lines_are_found_whole(spark):
    rng = random.Random(9)
    word = lambda: "u" + str(rng.randrange(10**9))
    line = " ".join(word() for _ in range(10))
    lines = "\n".join([line] * 200)
    head = " ".join(word() for _ in range(12))
    table = " ".join(f"{word()} {word()} {word()} {line}" for _ in range(150))
    docs = frame(spark, [lines, f"{head}\n{lines}", table, f"{head} {table}"])
    covered = {}
    for r in passages.repeated_passages(docs).collect():
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        assert r.first_doc != r.doc_id or r.first_start < r.start_word
    assert set(range(12, 2012)) <= covered[1] and set(range(100, 2000)) <= covered[0]
    assert set(range(12, 1962)) <= covered[3]


def test_neighbours_reach_their_recall_and_keep_ties(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(1500, 32)).astype(np.float32)
    vectors[700:760] = vectors[50]  # ties with a query
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(1501, None), (1502, [0.0] * 32), (1550, [float("nan")] * 32), (None, rows[0][1]), (1600, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", __import__("pyspark").sql.functions.lit(1))
    got = neighbours.nearest(df, df.vec_id % 50 == 0).collect()
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 1500, 50):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        s = np.round(unit @ unit[q], 12)
        s[q] = -2
        true = np.lexsort((np.arange(1500), -s))[:5]
        hits += len({r.vec_id for r in own} & set(true.tolist()))
        total += 5
        assert len(own) == 5 and all(r.score == pytest.approx(unit[q] @ unit[r.vec_id]) for r in own)
        if q == 50:
            assert [r.vec_id for r in own] == [700, 701, 702, 703, 704]
    assert hits / total >= 0.9 and not [r for r in got if r.query_id in (1550, 1600)]


def test_few_vectors_find_all_others(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [-1.0, 0.0, 0.1]), (2, [0.0, 1.0, 0.0])], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, df.vec_id % 50 == 0).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(1, 2), (2, 1)]


def test_toxicity_on_held_out_rows():
    rng = random.Random(3)
    bad = ["idiot", "moron", "worthless", "pathetic", "trash", "scum"]
    texts, toxic = [], []
    for i, t in enumerate(prose(900, 11)):
        words = t.split()
        if i % 8 == 0:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append(" ".join(words))
        toxic.append(int(i % 8 == 0))
    chain = toxicity.fit_chain(texts[:600], toxic[:600])
    x = np.zeros((300, len(chain.vocabulary)))
    for i, t in enumerate(texts[600:]):
        at, values = chain.features(t)
        x[i, at] = values
    p = chain.predict(x)
    assert p.shape[1] == 4 and np.mean((p[:, -1] >= 0.5) == np.array(toxic[600:])) > 0.97
    assert toxicity.fit_chain(["a"], [0]).links == ()


def test_toxicity_trains_on_texts_behind_a_huge_one(spark):
    texts = ["filler " * 200_000] + [("you idiot moron " if i % 2 else "a calm remark ") + f"w{i % 7}" for i in range(80)]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, i % 2 ^ (i > 0)) for i in range(81)], "doc_id long, toxic int")
    chain = toxicity.train(docs, labels, max_mb=1)
    assert chain.links and "idiot" in chain.vocabulary
    huge = frame(spark, ["filler " * 200_000, "calm", "filler " * 200_000])
    kinds = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, toxic int")
    with pytest.raises(ValueError):
        toxicity.train(huge, kinds, max_mb=1)


def test_neighbours_split_queries_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(14)
    vectors = rng.normal(size=(600, 16))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, neighbours.nearest(df, df.vec_id % 2 == 0).collect()))
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 30)
    monkeypatch.setattr(neighbours, "PART_QUERIES", 10)
    assert sorted(map(tuple, neighbours.nearest(df, df.vec_id % 2 == 0).collect())) == whole
    rows = df.selectExpr("vec_id AS id", "embedding AS vector")
    blocks = neighbours._blocks(rows, rows, 2, 0.25)
    sizes = rows.mapInArrow(lambda b: neighbours._bucketed(b, 2, 0.25, blocks, True), neighbours.BUCKETED).groupBy("width", "tab", "bucket", "block").count()
    assert max(r["count"] for r in sizes.collect()) <= 40


def test_packing_gives_every_token_back(spark, corpus):
    from tokenizers import Tokenizer

    texts = corpus + ["long " + " ".join("t" + str(i) for i in range(3000)), "odd space　here", "<|endoftext|> x"]
    rows = packing.pack(frame(spark, texts), shard_docs=16).collect()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    for i, t in enumerate(texts):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()] and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        total = sum(r.length for r in own)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()]
        assert total <= 2048 and total & (total - 1) == 0


def test_word_ids_equal_the_tokenizer():
    ids = packing.word_ids(packing.default_tokenizer())
    rng = random.Random(3)
    signs = ["a", "B", "é", "é", " ", " ", "\x1f", "\x85", "　", "\n", "^", "'s", "'LL", "1", "²", "<|endoftext|>", "Σ", "中", "😀", "\x00"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    for text, got in zip(texts, ids.batch(pa.array(texts)), strict=True):
        assert got.tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids


def test_neighbours_fill_a_window_first():
    tails = [np.full(600, 7), np.full(600, 9), np.full(600, 7), np.full(248, 7), np.full(600, 9)]
    first = packing.fill_windows([t.astype("<u2") for t in tails], 2048)[0]
    assert {d for d, _, _ in first[:3]} == {0, 2, 3}


def test_planted_neighbours_meet_in_a_table_of_many_shards(spark):
    rng = random.Random(12)
    listed = packing.word_ids(packing.default_tokenizer()).tokenizer.get_vocab()
    words = sorted(w[:-4] for w in listed if re.fullmatch("[a-z]{5,9}</w>", w))[:2009]
    topics = [rng.sample(words[9:], 12) for _ in range(80)]
    # three documents of a topic, far from one another in the table; topics share some words
    texts = [" ".join(rng.sample(topics[i % 80], 10) + rng.choices(words[:9], k=20)) for i in range(240)]
    docs = frame(spark, [*texts, *["the same text"] * 100, None, ""])
    rows = packing.pack(docs, window=256, shard_docs=16).collect()
    shard = {}
    for r in rows:
        shard.setdefault(r.doc_id, set()).add(r.sequence_id >> 24)
    assert len(shard) == 342 and all(len(x) == 1 for x in shard.values())
    sizes = Counter(next(iter(x)) for x in shard.values())
    assert len(sizes) > 10 and max(sizes.values()) <= 32
    met = sum(len(shard[i] & shard[i + 80] | shard[i] & shard[i + 160] | shard[i + 80] & shard[i + 160]) > 0 for i in range(80))
    assert met >= 64


def plain_figures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_figures_and_outliers(spark, corpus):
    texts = corpus + ["a b c\na b c\n\n \na b c d", "x x x x x", "# * | < >\n# * | < >"] + prose(120, 21)
    outlier = " | ".join("q" + str(i) for i in range(200))
    texts.append(outlier)
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_figures(t), t
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert not got[len(texts) - 1].kept and not got[len(texts) - 1].base_failed
    assert all(got[i].kept for i in range(len(corpus) + 3, len(texts) - 1) if not got[i].base_failed)


def test_minimum_covariance_determinant_against_numpy(spark):
    """The concentration steps in plain numpy give the same distances."""
    docs = frame(spark, prose(200, 33))
    rows = quality._statistics(quality.figures(docs)).filter("n_words >= 50").orderBy("doc_id")
    x = np.array([[r[s] for s in quality.STATISTICS] for r in rows.collect()], float)
    floors = np.array(quality.FLOORS)
    middle = np.array([np.sort(x[:, i])[(len(x) - 1) // 2] for i in range(5)])
    score = (((x - middle) / (1000 * floors)) ** 2).sum(1)
    for _ in range(quality.STEPS + 1):
        bins = np.floor(np.log2(np.maximum(score, 1e-6)) * quality.BINS)
        last = next(b for b in np.unique(bins) if (bins <= b).sum() >= quality.CORE * len(x))
        core = x[bins <= last] / 1000
        cov = core.T @ core / len(core) - np.outer(core.mean(0), core.mean(0)) + np.diag(floors**2)
        z = x / 1000 - core.mean(0)
        score = np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z)
    got = [r.distance for r in quality.judge(docs).orderBy("doc_id").collect() if not r.base_failed]
    assert np.allclose(got, score)


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    texts = prose(160, 41)
    texts[10] = texts[11] = texts[12]
    texts[20] += " call +1 (234) 555-1234"
    bad = ["idiot", "moron", "worthless", "pathetic", "trash", "scum"]
    toxic = {i for i in range(0, 160, 5)}
    for i in toxic - {10}:
        texts[i] += " " + " ".join(rng.choice(bad) for _ in range(6))
    docs = spark.createDataFrame([(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic - {10})) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept, docs = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{at}")
        docs = spark.read.parquet(f"{tmp_path}/{at}")
        kept.append([tuple(r) for r in docs.collect()])
        if at < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r[0] for r in kept[0]} == set(range(160)) - (toxic - {10})
    assert {r[0] for r in kept[1]} == {r[0] for r in kept[0]} - {11, 12}
    assert not [r for r in kept[2] if "+1 (234)" in r[1]] and len(kept[2]) == len(kept[1])
    assert {r[0] for r in kept[4]} == {r[0] for r in kept[3]}
    words = sum(len(r[1].split()) for r in kept[2])
    assert abs(sum(len(r[1].split()) for r in kept[3]) - 1.5 * words) < 200
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept[4])


def test_columns_of_any_name_go_along(spark):
    """Stages keep extra columns whose names hold dots or clash with helper names."""
    texts = prose(30, 77) + ["you idiot moron " * 4] * 3
    docs = frame(spark, texts)
    odd = docs.withColumns({"_row_key": F.lit(1), "doc": F.lit("x"), "size": F.lit(2), "_text": F.lit("t")}).withColumn("key", F.struct(F.lit(1).alias("in.ner")))
    odd = odd.toDF(*[{"doc": "do.t", "size": "si`ze"}.get(c, c) for c in odd.columns])
    labels = spark.createDataFrame([(i, 1, int(i >= 30)) for i in range(33)], "doc_id long, quality int, toxic int")
    for out in (toxicity.clean_documents(odd, labels), jaccard_join.one_per_component(odd), pii.redacted_documents(odd), mixing.mixed_documents(odd)):
        assert out.columns == odd.columns and out.count() > 0
        assert out.schema["key"].dataType == odd.schema["key"].dataType


def test_toxicity_of_copies_is_learnt_in_one_fold(spark):
    texts = [f"text {i % 9} idiot" if i % 2 else f"text {i % 9} fine" for i in range(60)]
    folds = {t: toxicity.fold_of(t, 4) for t in texts}
    assert set(folds.values()) <= set(range(4)) and len(set(folds.values())) > 1
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    on_executors = toxicity.train(frame(spark, texts), labels)
    plain = toxicity.fit_chain(texts, [i % 2 for i in range(60)])
    assert on_executors.vocabulary == plain.vocabulary
    for a, b in zip(on_executors.links, plain.links):
        assert np.allclose(a.words, b.words) and np.allclose(a.earlier, b.earlier) and np.isclose(a.bias, b.bias)


def _long_texts(n, words=3000, shared=0.5, seed=21):
    """Unrelated long texts that share pages of boilerplate."""
    rng = random.Random(seed)
    page = [f"page{i}" for i in range(int(words * shared))]
    return [" ".join(page + [f"own{t}x{rng.randrange(10**9)}" for _ in range(words - len(page))]) for t in range(n)]


def test_long_texts_with_a_common_page_are_no_candidates(spark, monkeypatch):
    """Candidates grow in proportion to the texts, not with the square of the group that shares the page."""
    asked = []
    verify = jaccard_join.Join.verified
    monkeypatch.setattr(jaccard_join.Join, "verified", lambda self, pairs: asked.append(pairs.count()) or verify(self, pairs))
    figures = []
    for n in (100, 400):
        texts = _long_texts(n)
        texts += [texts[3] + " end", texts[5].replace("own5x", "new5x", 90)]
        got = jaccard_join.similar_documents(frame(spark, texts)).collect()
        groups = {r.doc_id: r.component_id for r in got}
        assert groups[n] == 3 and groups[n + 1] in (5, n + 1) and sum(v != k for k, v in groups.items()) <= 2
        figures.append(sum(asked))
        asked.clear()
    assert figures[1] < 6 * figures[0] + 1000, figures


def test_large_groups_that_quote_a_page_meet_by_rare_tokens(spark, monkeypatch):
    """Differences from a pivot are not formed for sets that share a page and little else; what links is still found."""
    asked = []
    across = jaccard_join.Join.across
    monkeypatch.setattr(jaccard_join, "FEW", 5)
    monkeypatch.setattr(jaccard_join.Join, "across", lambda self, rows, found: asked.append(rows.count()) or across(self, rows, found))
    texts = _long_texts(30, 300, 0.7)
    own = random.Random(4)
    for t in (3, 5, 5, 5, 9):  # copies by steps that a pivot does not link
        words = texts[t].split()
        for i in own.sample(range(210, 300), 3):
            words[i] = f"new{own.randrange(10**6)}"
        texts.append(" ".join(words))
    got = jaccard_join.similar_documents(frame(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == components(texts)
    assert sum(asked) == 0, asked


def test_folded_sketches_bound_the_difference(spark):
    rng = random.Random(6)
    texts = []
    for n in (30, 400, 900, 1100, 2500, 5200):
        base = [f"t{rng.randrange(10**8)}" for _ in range(n)]
        for share in (0.0, 0.02, 0.1):
            texts.append(" ".join(w if rng.random() >= share else w + "x" for w in base))
    rows = frame(spark, texts)
    join = jaccard_join.Join(rows, 80)
    ids = join.sets.select("set")
    data = {r.set: r for r in join._data(ids, False).collect()}
    of = {r.doc_id: r.set for r in join.sets.collect()}
    words = [t.split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if min(len(sets[i]), len(sets[j])) * 100 >= 80 * max(len(sets[i]), len(sets[j]))]
    df = spark.createDataFrame([(i, j, data[of[i]].fold, data[of[j]].fold) for i, j in pairs], "i int, j int, fa array<long>, fb array<long>")
    for r in df.select("i", "j", jaccard_join.differing("fa", "fb").alias("d")).collect():
        true = len(sets[r.i] ^ sets[r.j])
        assert r.d <= true and (r.d - true) % 2 == 0
        if true > 0.9 * (len(sets[r.i]) + len(sets[r.j])):  # unrelated
            assert 180 * (len(sets[r.i]) + len(sets[r.j]) - r.d) < 160 * (len(sets[r.i]) + len(sets[r.j]))


def test_neighbours_of_huge_and_tiny_vectors(spark):
    rng = np.random.default_rng(3)
    plain = rng.normal(size=(60, 8))
    for factor in (1e200, 1e-200, 1.0):
        df = spark.createDataFrame([(i, (v * factor).tolist()) for i, v in enumerate(plain)], "vec_id long, embedding array<double>")
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in neighbours.nearest(df, df.vec_id % 50 == 0).collect()}
        assert len(got) == 10 and all(np.isfinite(s) and -1 <= s <= 1.000001 for _, s in got.values())
        for q in (0, 50):
            near = plain @ plain[q] / np.linalg.norm(plain, axis=1) / np.linalg.norm(plain[q])
            near[q] = -2
            assert got[q, 1][0] == int(near.argmax()) and got[q, 1][1] == pytest.approx(near.max(), abs=1e-12)
    nothing = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert neighbours.nearest(nothing, nothing.vec_id % 50 == 0).count() == 0


def test_digests_hash_a_piece_of_texts_at_a_time(monkeypatch):
    seen = []
    plain = substrings.RangeHash
    monkeypatch.setattr(substrings, "RangeHash", lambda data, seed: seen.append(len(data)) or plain(data, seed))
    batch = pa.record_batch({"doc_id": pa.array(range(40), pa.int64()), "text": ["x" * 200_000] * 39 + [None]})
    out = list(substrings._digested([batch], None, False))
    assert sum(b.num_rows for b in out) == 40
    assert max(seen) <= 1 << 20


def test_packed_hashes_keep_every_repeated_one(spark):
    from vulnlake.llm.common import PACKED, in_bit_map, packed_hashes, repeated_hashes

    values = np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 5000)
    parts = [values, values[:100], np.repeat(values[100:101], 5000)]
    assert sum(len(x) for b in packed_hashes(iter(parts), 8) for x in b.column("data").to_pylist()) == 4 * (5000 + 101)
    rows = spark.range(3).repartition(3).mapInArrow(
        lambda bs: packed_hashes((parts[i] for b in bs for i in b.column("id").to_pylist()), 8), PACKED)
    found = in_bit_map(repeated_hashes(rows, 1 << 26).value, values)
    assert found[:101].all() and found[101:].sum() < 5


def test_few_new_words_are_tokenised_together(monkeypatch):
    words = packing.WordIds(packing.default_tokenizer())
    plain, most = words._ids, []
    monkeypatch.setattr(words, "_ids", lambda text: most.append(len(text.split())) or plain(text))
    text = " ".join(f"w{i}" for i in range(30_000))
    got = next(words.batch(pa.array([text])))
    assert max(most) < 2 * packing.LEARNED
    assert got.tolist() == plain(text)


def test_keys_of_all_windows_are_those_of_the_windows():
    from types import SimpleNamespace

    text = " ".join(f"w{i * i % 97}" for i in range(400))
    batch = pa.record_batch({"doc_id": pa.array([1, 2], pa.int64()), "text": [text, None]})
    every = SimpleNamespace(value=np.full(1 << 10, 255, np.uint8))
    keys = np.concatenate(list(passages._window_keys([batch], 46, 2)))
    rows = pa.Table.from_batches(passages._windows([batch], 46, 2, every, True))
    assert len(keys) and sorted(keys.tolist()) == sorted(rows.column("key").to_pylist())
