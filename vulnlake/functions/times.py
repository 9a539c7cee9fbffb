"""Time expressions; the session time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vulnlake import constants as K


def epoch_of_iso(text: Column) -> Column:
    return F.unix_timestamp(F.try_to_timestamp(text))


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def runtime_parts(seconds: Column) -> tuple[Column, Column, Column]:
    """Hours, minutes and seconds of a whole number of seconds."""
    hours = F.floor(seconds / 3600)
    minutes = F.floor((seconds - hours * 3600) / 60)
    return hours, minutes, seconds - hours * 3600 - minutes * 60


def within_signed_days(version: Column, commit: Column, days: Column) -> Column:
    """Commit time between the version's time and ``days`` after it, before it when negative."""
    end = version + days * K.DAY_SECONDS
    return commit.between(F.least(version, end), F.greatest(version, end))
