"""Dates, instants and season labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_day_first(c: Column) -> Column:
    """dd/mm/yyyy or dd/mm/yy, NULL when neither."""
    return F.to_date(F.coalesce(F.try_to_timestamp(F.when(F.length(c) == 10, c), F.lit("dd/MM/yyyy")),
                                F.try_to_timestamp(F.when(F.length(c) == 8, c), F.lit("dd/MM/yy"))))


def london_day(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, "Europe/London"))


def season_label(start_year: Column) -> Column:
    """2022 -> 2022-23."""
    return F.concat(start_year.cast("string"), F.lit("-"), F.lpad(((start_year + 1) % 100).cast("string"), 2, "0"))


def season_start(label: Column) -> Column:
    return F.substring(label, 1, 4).cast("int")


def season_url(label: Column) -> Column:
    """2022-23 -> 2223."""
    return F.concat(F.substring(label, 3, 2), F.substring(label, 6, 2))


def season_from_text(c: Column) -> Column:
    """2025/26 or 2025/2026 anywhere in a text -> 2025-26, NULL when absent."""
    start = F.regexp_extract(c, r"(\d{4})/(\d{2,4})", 1)
    return F.when(start != "", season_label(start.try_cast("int")))
