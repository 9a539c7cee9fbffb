"""License scans over a positional index of rare template words, in DataFrame operations only.

Every license notice is a template of words.  The index keeps, per template, its words of highest inverse
document frequency among the templates and the words of its mandatory key phrase, each with its position.  A
file's words that the index knows are looked up; hits that agree on a template and on where that template would
begin in the file (file position less template position) are one alignment.  A template is found where an
alignment holds the whole key phrase and enough of the weight of the template's rare words.  Beside it stand the
plain phrases: places where "mit license", "apache license" or "general public license" stand consecutively.

The index is fixed and small (one row per template word kept), so it may be broadcast; files are never paired
with each other, and only hits are shuffled, keyed by file.

Null and empty texts have no words and no labels; repeated rows are scanned each for itself; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import cut_lineage

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


class Template(NamedTuple):
    label: str
    key: str
    words: str


#: Public notices, as lower-case words; ``key`` must stand in the file as it is.
TEMPLATES = (
    Template("mit", "released under the mit license", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
             "documentation files the software to deal in the software without restriction including without limitation "
             "the rights to use copy modify merge publish distribute sublicense"),
    Template("apache", "licensed under the apache license", "licensed under the apache license version 2 0"),
    Template("apache", "you may not use this file except in compliance with the license",
             "you may not use this file except in compliance with the license you may obtain a copy of the license"),
    Template("gpl", "gnu general public license", "this work is licensed under the gnu general public license version 3"),
    Template("gpl", "terms of the gnu general public license",
             "you can redistribute it and or modify it under the terms of the gnu general public license as published by "
             "the free software foundation"),
    Template("lgpl", "gnu lesser general public license",
             "under the terms of the gnu lesser general public license as published by the free software foundation"),
    Template("agpl", "gnu affero general public license",
             "under the terms of the gnu affero general public license as published by the free software foundation"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             "redistribution and use in source and binary forms with or without modification are permitted provided "
             "that the following conditions are met"),
    Template("mpl", "mozilla public license",
             "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("isc", "permission to use copy modify and or distribute this software",
             "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("boost", "boost software license", "distributed under the boost software license version 1 0"),
    Template("unlicense", "unencumbered software released into the public domain",
             "this is free and unencumbered software released into the public domain"),
    Template("cc-by", "cc by 4", "licensed under cc by 4 0"),
    Template("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    Template("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    Template("cc-by-nd", "cc by nd", "licensed under cc by nd 4 0"),
)


class Posting(NamedTuple):
    word: str
    template: int
    position: int
    weight: int  # thousandths of the word's inverse document frequency; 0 for words kept for the key phrase alone
    in_key: int


def postings(templates: Sequence[Template] = TEMPLATES, rare: int = 8) -> list[Posting]:
    """The index: per template its ``rare`` words of highest inverse document frequency, and its key phrase."""
    split = [t.words.split() for t in templates]
    df = Counter(w for words in split for w in set(words))
    out = []
    for n, (template, words) in enumerate(zip(templates, split, strict=True)):
        idf = [round(1000 * math.log(1 + len(templates) / df[w])) for w in words]
        best = sorted(range(len(words)), key=lambda i: (-idf[i], i))[:rare]
        key = template.key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        for i, w in enumerate(words):
            in_key = int(at <= i < at + len(key))
            if i in best or in_key:
                out.append(Posting(w, n, i, idf[i] if i in best else 0, in_key))
    return out


def rarest(templates: Sequence[Template]) -> list[str]:
    """One word of each template's key phrase, the longest: no file without it can match."""
    return sorted({max(t.key.split(), key=lambda w: (len(w), w)) for t in templates})


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _places(words: Column, phrase: str) -> Column:
    """Start positions of a phrase; the array is looked through only where its last word occurs."""
    parts = phrase.split()
    n = len(parts)

    def stands(i: Column) -> Column:
        test = F.lit(True)
        for j in reversed(range(n)):
            test = test & (F.get(words, i + j) == parts[j])
        return test

    found = F.filter(F.sequence(F.lit(0), F.size(words) - n), stands)
    none = F.array().cast("array<int>")
    return F.when((F.size(words) >= n) & F.array_contains(words, parts[0]), found).otherwise(none)


def scan(
    docs: DataFrame, templates: Sequence[Template] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES,
    rare: int = 8, least: float = 0.6,
) -> DataFrame:
    """License evidence of every document.

    Returns doc_id, n_words, n_base (places of the phrases), first_word and last_word (smallest and largest
    start of a place), base_labels and labels (with those of templates found), score (the largest share of a
    found template's weight, 1 where a phrase stands, else 0).  A template counts from a share of ``least``.
    """
    spark = docs.sparkSession
    index = postings(templates, rare)
    key_size = Counter(p.template for p in index if p.in_key)
    total = Counter()
    for p in index:
        total[p.template] += p.weight
    known = spark.createDataFrame(
        [(p.word, p.template, p.position, p.weight, p.in_key, templates[p.template].label, key_size[p.template], total[p.template]) for p in index],
        "word string, template int, position int, weight long, in_key int, label string, key_size int, total long",
    )
    row = [F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_text")]
    listed = docs.select(*row, words_of(F.col("text")).alias("words"))
    last = F.array(*[F.lit(w) for w in sorted({p.split()[-1] for p, _ in phrases})])
    listed = listed.withColumn("_any", F.arrays_overlap("words", last))
    none = F.array().cast("array<int>")
    for n, (phrase, _) in enumerate(phrases):
        listed = listed.withColumn(f"_p{n}", F.when(F.col("_any"), _places(F.col("words"), phrase)).otherwise(none))
    places = F.concat(*[F.col(f"_p{n}") for n in range(len(phrases))])
    signs = F.array(*[F.lit(w) for w in rarest(templates)])
    whole_key = F.lit(False)
    for key in sorted({t.key for t in templates}):
        whole_key = whole_key | reduce(and_, (F.array_contains("words", w) for w in sorted(set(key.split()), key=lambda w: (-len(w), w))))
    indexed = sorted({p.word for p in index})
    hits = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda h: h["word"].isin(indexed))
    # one pass over the texts; what it leaves is narrow, and is read by both sides of the join below
    base = cut_lineage(listed.select(
        "doc_id", "_text", F.size("words").cast("long").alias("n_words"), F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        F.array_compact(F.array(*[F.when(F.size(f"_p{n}") > 0, label) for n, (_, label) in enumerate(phrases)])).alias("_base"),
        F.when(F.arrays_overlap("words", signs), F.when(whole_key, hits)).alias("_hits"),
    ))
    hits = (
        base.select("doc_id", "_text", F.explode("_hits").alias("_hit")).select("doc_id", "_text", "_hit.at", "_hit.word")
        .join(F.broadcast(known), "word")  # as many rows as the templates have words, whatever the input
        .groupBy("doc_id", "_text", "template", (F.col("at") - F.col("position")).alias("begin"), "label", "key_size", "total", "position")
        .agg(F.max("weight").alias("weight"), F.max("in_key").alias("in_key"))
        .groupBy("doc_id", "_text", "template", "begin", "label", "key_size", "total")
        .agg(F.sum("weight").alias("weight"), F.sum("in_key").alias("in_key"))
        .filter((F.col("in_key") == F.col("key_size")) & (F.col("weight") >= F.col("total") * least))
    )
    found = hits.groupBy(F.col("doc_id").alias("_d"), F.col("_text").alias("_t")).agg(
        F.collect_set("label").alias("_found"), F.max(F.col("weight") / F.col("total")).alias("_share")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_t"))
    every = F.array_sort(F.array_union("_base", F.coalesce("_found", F.array().cast("array<string>"))))
    return base.join(found, same, "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("_base")), ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"),
    )


def _quoted(x: object) -> str:
    return f"'{x}'" if isinstance(x, str) else str(x)


def sql(templates: Sequence[Template] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, rare: int = 8, least: float = 0.6) -> str:
    """The same scan in DuckDB over ``documents`` (ids taken as unique), phrases by comparing neighbours."""
    index = postings(templates, rare)
    key_size = Counter(p.template for p in index if p.in_key)
    total = Counter()
    for p in index:
        total[p.template] += p.weight
    values = ", ".join(
        "(" + ", ".join(map(_quoted, (p.word, p.template, p.position, p.weight, p.in_key, templates[p.template].label, key_size[p.template], total[p.template]))) + ")"
        for p in index
    )
    stands = " UNION ALL ".join(
        f"SELECT a.doc_id, a.pos, '{label}' AS label FROM words a"
        + "".join(f" JOIN words w{j} ON w{j}.doc_id = a.doc_id AND w{j}.pos = a.pos + {j} AND w{j}.word = '{w}'" for j, w in enumerate(phrase.split()) if j)
        + f" WHERE a.word = '{phrase.split()[0]}'"
        for phrase, label in phrases
    )
    return rf"""WITH listed AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
  FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM listed WHERE len(ws) > 0),
base AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list_distinct(list(label))) AS labels
  FROM ({stands}) GROUP BY doc_id),
idx(word, template, position, weight, in_key, label, key_size, total) AS (VALUES {values}),
hits AS (
  SELECT DISTINCT w.doc_id, i.template, w.pos - i.position AS begins, i.position, i.weight, i.in_key, i.label, i.key_size, i.total
  FROM words w JOIN idx i ON w.word = i.word),
aligned AS (
  SELECT doc_id, label, sum(weight) / any_value(total) AS part FROM hits GROUP BY doc_id, template, begins, label
  HAVING sum(in_key) = any_value(key_size) AND sum(weight) >= any_value(total) * {least}::DOUBLE),
found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(part) AS part FROM aligned GROUP BY doc_id)
SELECT l.doc_id, len(l.ws)::BIGINT AS n_words, coalesce(b.n_base, 0)::BIGINT AS n_base, b.first_word::BIGINT AS first_word, b.last_word::BIGINT AS last_word,
  coalesce(array_to_string(b.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ','), '') AS labels,
  CASE WHEN b.n_base > 0 THEN 1.0 ELSE coalesce(f.part, 0.0) END::DOUBLE AS score
FROM listed l LEFT JOIN base b ON b.doc_id = l.doc_id LEFT JOIN found f ON f.doc_id = l.doc_id"""
