"""Version and tag expressions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnlake import constants as K

SENTENCE_END = r"[.!?]\s+|\n"


def digits_of_tag(tag: Column) -> Column:
    return F.array_join(F.regexp_extract_all(tag, F.lit(r"\d+"), F.lit(0)), ".")


def dotted_tag(tag: Column) -> Column:
    return F.regexp_replace(tag, "[^0-9a-zA-Z]+", ".")


def is_rc_or_date(tag: Column) -> Column:
    return F.lower(tag).rlike(r"[^a-z]?rc[^a-z]|\d{9,}")


def ends_with_zero(version: Column) -> Column:
    """A final 0 after any character from ``.`` to ``_`` in the character table."""
    return version.rlike(r"[\x2e-\x5f]0$")


def cpe_ranges(configurations: Column) -> Column:
    """Interval text of every match entry of every node, in order."""
    matches = F.flatten(F.flatten(F.transform(
        configurations, lambda c: F.transform(c["nodes"], lambda n: n["cpeMatch"]))))

    def interval(m: Column) -> Column:
        named = F.element_at(F.split(m["criteria"], ":"), 6)
        start = (
            F.when(m["versionStartIncluding"].isNotNull(), F.concat(F.lit("["), m["versionStartIncluding"]))
            .when(m["versionStartExcluding"].isNotNull(), F.concat(F.lit("("), m["versionStartExcluding"]))
            .when(m["criteria"].isNull(), F.lit("(None"))
            .when(named.rlike(r"^\d+\.(?:\d+\.*)*\d"), F.concat(F.lit("["), named))
            .otherwise(F.lit("None"))
        )
        end = (
            F.when(m["versionEndIncluding"].isNotNull(), F.concat(m["versionEndIncluding"], F.lit("]")))
            .when(m["versionEndExcluding"].isNotNull(), F.concat(m["versionEndExcluding"], F.lit(")")))
            .otherwise(F.lit("None)"))
        )
        return F.concat(start, F.lit(":"), end)

    return F.transform(matches, interval)


def last_range(ranges: Column) -> Column:
    """The last interval without brackets, ``None:None`` when there is none."""
    last = F.try_element_at(ranges, F.lit(-1))
    return F.coalesce(F.regexp_replace(last, r"^[\[\]()]+|[\[\]()]+$", ""), F.lit("None:None"))


def node_versions(configurations: Column) -> tuple[Column, Column]:
    """Affected and fixed versions of the first node of the first configuration."""
    node = F.get(F.get(configurations, F.lit(0))["nodes"], F.lit(0))["cpeMatch"]
    affected = F.transform(node, lambda m: F.coalesce(m["versionEndIncluding"], m["versionStartIncluding"]))
    fixed = F.transform(node, lambda m: m["versionEndExcluding"])
    return tuple(F.filter(v, lambda x: x.isNotNull()) for v in (affected, fixed))


def versions_near(text: Column, near: list[str]) -> Column:
    """Last version, in text order, of a sentence that holds one of the words."""
    sentences = F.filter(
        F.split(text, SENTENCE_END), lambda s: F.exists(F.array(*[F.lit(w) for w in near]), lambda w: s.contains(w))
    )
    found = F.flatten(
        F.transform(sentences, lambda s: F.regexp_extract_all(s, F.lit(r"\d+\.(?:\d+\.*)*\d"), F.lit(0)))
    )
    return F.try_element_at(found, F.lit(-1))


def affected_and_fixed(text: Column) -> tuple[Column, Column]:
    """Affected and fixed version of an advisory text.

    The nearest word never decides between versions, since distances start anew for every version; so
    within the sentences that hold a listed word the last version in text order wins.
    """
    return versions_near(text, K.AFFECTED_VERSION_WORDS), versions_near(text, K.FIXED_VERSION_WORDS)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block similarity of two texts, 0 to 1."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")
