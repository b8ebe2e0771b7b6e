"""Timestamps as the claim graph reads them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_ts(c: Column) -> Column:
    """Instant of an ISO text: the whole, else the part before a dot, else the date; no zone means UTC; else null."""
    t = F.trim(F.coalesce(c, F.lit("")))
    shape = r"^\d{4}-\d{2}-\d{2}"
    zoned = F.when(t.rlike(r"(Z|[+-]\d{2}:\d{2})$") & (F.length(t) > 10), t).when(F.length(t) > 10, F.concat(t, F.lit("Z"))).otherwise(t)
    whole = F.try_to_timestamp(F.regexp_replace(zoned, r"^(\d{4}-\d{2}-\d{2}) ", "$1T"))
    cut = F.try_to_timestamp(F.concat(F.substring_index(t, ".", 1), F.lit("Z")))
    return F.when(t.rlike(shape), F.coalesce(whole, cut, F.try_to_timestamp(F.concat(F.substring(t, 1, 10), F.lit("T00:00:00Z")))))


def parse_ts_sql(x: str) -> str:
    """Microseconds of parse_ts() for DuckDB."""
    t = f"trim(coalesce({x}, ''))"
    whole = f"TRY_CAST(CASE WHEN length({t}) = 10 THEN {t} || ' 00:00:00+00' WHEN regexp_matches({t}, '(Z|[+-]\\d{{2}}:\\d{{2}})$') AND length({t}) > 10 THEN {t} ELSE {t} || '+00' END AS TIMESTAMPTZ)"
    cut = f"TRY_CAST(split_part({t}, '.', 1) || '+00' AS TIMESTAMPTZ)"
    day = f"TRY_CAST(left({t}, 10) || ' 00:00:00+00' AS TIMESTAMPTZ)"
    return f"CASE WHEN regexp_matches({t}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN epoch_us(coalesce({whole}, {cut}, {day})) END"


def detect_as_of(question: Column) -> tuple[Column, Column]:
    """(instant, question without the phrase) of 'as of 2026-03-01' or 'as of March 1, 2026'."""
    pattern = r"(?i)as of ([0-9]{4}-[0-9]{2}-[0-9]{2}|[a-z]+ [0-9]{1,2},? [0-9]{4})"
    raw = F.replace(F.regexp_extract(question, pattern, 1), F.lit(","), F.lit(""))
    words = F.split(raw, " ")
    months = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
    month = F.array_position(F.array(*map(F.lit, months)), F.lower(words[0]))
    named = F.when((F.size(words) == 3) & (month > 0), F.try_make_timestamp(F.get(words, F.lit(2)).try_cast("int"), month.cast("int"), F.get(words, F.lit(1)).try_cast("int"), F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"), F.lit("UTC")))
    return F.when(raw.rlike(r"^\d{4}"), F.try_to_timestamp(F.concat(raw, F.lit("T00:00:00Z")))).otherwise(named), F.regexp_replace(question, pattern, " ")
