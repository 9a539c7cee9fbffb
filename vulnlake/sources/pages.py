"""Stored web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.functions import text as X


def links(pages: DataFrame) -> DataFrame:
    """Every link target of a page."""
    return pages.select("page_id", F.explode(X.page_links(F.col("html"))).alias("link"))


def code_links(pages: DataFrame) -> DataFrame:
    """Links to GitHub or the Apache ticket system."""
    return links(pages).filter(F.col("link").rlike(r"^https://(github\.com|issues\.apache\.org/jira)"))


def tracker_links(pages: DataFrame, block: str = r"(?s)<pre[^>]*>(.*?)</pre>") -> DataFrame:
    """Links inside the preformatted notes of a tracker page."""
    notes = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(block), F.lit(1))).alias("html"))
    return links(notes)


def ticket_text(tickets: DataFrame) -> DataFrame:
    """Summary, description and comments of a ticket's XML ``(issue_id, xml)`` as plain text."""
    parts = F.flatten(F.array(*[
        F.xpath("xml", F.lit(f"//item/{name}//text()")) for name in ("description", "summary", "comments")
    ]))
    plain = F.transform(parts, lambda p: F.trim(F.regexp_replace(X.html_text(p), r"\s+", " ")))
    return tickets.select("issue_id", F.array_join(F.filter(plain, lambda p: p != ""), " ").alias("content"))
