"""Cleaning expressions. All are null-safe under ANSI mode and stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from carlake import rules


def _to_double(c: Column) -> Column:
    """``try_cast`` to double. The parser throws and catches an exception for each text that is no number, so texts
    without a digit, infinity or NaN are sorted out first."""
    return F.when(c.rlike("[0-9]|[iI][nN][fF]|[nN][aA][nN]"), c.try_cast("double"))


def to_int(c: Column) -> Column:
    """Whole number from text; a fraction is cut off ('2020.0' -> 2020), other text gives NULL."""
    return _to_double(c).try_cast("int")


def to_number(c: Column) -> Column:
    """Decimal number from text, NULL where the text is not a plain number."""
    plain = c.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")
    return F.when(plain, c.try_cast("double"))


def standardize_name(c: Column, variants: Mapping[str, Sequence[str]] = rules.MAKER_VARIANTS) -> Column:
    """The standard name of a spelling variant; an unknown name is kept as it is."""
    pairs = [F.lit(x) for name, spellings in variants.items() for s in spellings for x in (s, name)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.upper(F.trim(c))), c)


def first_name(first: Column, second: Column) -> Column:
    return F.coalesce(first, second)


def clean_year(c: Column, lo: int = 1990, hi: int = 2030, sentinels: Sequence[int] = (9999,)) -> Column:
    year = to_int(c)
    return F.when(year.between(lo, hi) & ~year.isin(list(sentinels)), year)


def parse_yyyymmdd(c: Column) -> Column:
    """Date from eight digits. Parsers throw and catch an exception for each bad text, so texts that cannot be a date
    are sorted out first, and the day is counted from the first of its month."""
    plausible = c.rlike(r"^\d{4}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])$") & (F.length(c) == 8)
    year, month, day = (F.substring(c, start, n).try_cast("int") for start, n in ((1, 4), (5, 2), (7, 2)))
    first = F.make_date(year, month, F.lit(1))
    return F.when(plausible, F.when(day <= F.day(F.last_day(first)), F.date_add(first, day - 1)))


def clean_date(c: Column, fmt: str = "yyyyMMdd", min_year: int = 1990) -> Column:
    """Eight characters that form a date not before ``min_year``; sentinels and anything else give NULL."""
    if fmt == "yyyyMMdd":
        parsed = parse_yyyymmdd(c)
    else:
        parsed = F.when(F.length(c) == 8, F.try_to_date(c, fmt))
    parsed = F.when(~c.isin(rules.DATE_SENTINELS), parsed)
    return F.when(F.year(parsed) >= min_year, parsed)


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; none is left at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_text(c: Column) -> Column:
    """Text without tags, wrongly decoded runs and extra white space; empty text is NULL."""
    text = strip_tags(c)
    for wrong, right in rules.MOJIBAKE:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return F.nullif(squeeze(text), F.lit(""))


def yn_to_bool(c: Column) -> Column:
    letter = F.upper(F.trim(c))
    return F.when(letter == "Y", True).when(letter == "N", False)


def null_to_zero_int(c: Column) -> Column:
    """NULL counts as 0, text that is no number stays unknown."""
    return F.when(c.isNull(), F.lit(0)).otherwise(to_int(c))


def clamp_null(c: Column, lo: float, hi: float) -> Column:
    value = _to_double(c)
    return F.when(value.between(lo, hi), value)


def clean_star(c: Column) -> Column:
    text = F.upper(F.trim(c.cast("string")))
    return F.when(~text.isin(rules.STAR_SENTINELS), clamp_null(c, 1, 5))


def feature_flag(c: Column) -> Column:
    return F.coalesce(F.upper(F.trim(c.cast("string"))).isin(rules.FEATURE_WORDS), F.lit(False))


def norm_label(c: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(c, r"[^a-zA-Z0-9\s]", "_")))


def upper_trim(c: Column) -> Column:
    return F.upper(F.trim(c))


def lineage(source: str, as_of: datetime, version: str = "1.0") -> list[Column]:
    """The three lineage columns; the time is an argument so that a rerun gives the same rows."""
    return [
        F.lit(as_of).cast("timestamp_ntz").alias("processed_at"),
        F.lit(source).alias("data_source"),
        F.lit(version).alias("processing_version"),
    ]
