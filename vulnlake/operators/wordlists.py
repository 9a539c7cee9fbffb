"""Word lists of texts against a whole collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.text import alphanumeric_tokens


def relevant_words(texts: DataFrame, key: str, text: str, longer_than: int = 3, stop_share: float = 0.2) -> DataFrame:
    """Distinct words of each text ``(key, word)`` without those that too many texts have.

    Stands in for a part-of-speech tagger: words in more than ``stop_share`` of the texts say nothing.
    """
    words = texts.select(key, F.explode(alphanumeric_tokens(F.col(text), longer_than)).alias("word"))
    total = texts.agg(F.count("*").alias("_all"))
    seen = words.groupBy("word").agg(F.count("*").alias("_df"))
    # one row, so the product is the list of words itself
    stop = seen.join(total, F.col("_df") > F.col("_all") * stop_share).select("word")
    return words.join(stop, "word", "left_anti").select(key, "word")


def words_in_common(texts: DataFrame, key: str, text: str, other: DataFrame, other_text: str, exclude: str = "") -> DataFrame:
    """Words of each text ``(key, word)`` that any text of the other side has, unless part of ``exclude``."""
    words = texts.select(key, F.explode(alphanumeric_tokens(F.col(text), 3)).alias("word"))
    known = other.select(F.explode(alphanumeric_tokens(F.col(other_text), 3)).alias("word")).distinct()
    return words.filter(~F.contains(F.lit(exclude), "word")).join(known, "word", "left_semi").select(key, "word")
