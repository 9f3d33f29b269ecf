"""Derived columns: severity, categories, bands, flags and keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from carlake import rules


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def first_match(cases: Sequence[tuple[Column, Column | str]], rest: Column | str | None) -> Column:
    """Value of the first true condition."""
    out = F
    for condition, value in cases:
        out = out.when(condition, value)
    return out.otherwise(rest)


def severity(deaths: Column, injured: Column, crash: Column, fire: Column) -> Column:
    return first_match([(deaths > 0, "CRITICAL"), (injured > 0, "HIGH"), (crash | fire, "MEDIUM")], "LOW")


def has_incident(deaths: Column, injured: Column, crash: Column, fire: Column) -> Column:
    return F.coalesce(crash | fire | (injured > 0) | (deaths > 0), F.lit(False))


def categorize(c: Column, cases=rules.COMPONENT_RULES, rest: str = rules.COMPONENT_OTHER) -> Column:
    """Category of the first rule whose word occurs in the upper-cased text."""
    text = F.upper(c)
    return first_match([(text.contains(word), label) for word, label in cases], rest)


def status(close: Column) -> Column:
    return F.when(close.isNull(), "OPEN").otherwise("CLOSED")


def duration_days(opened: Column, close: Column) -> Column:
    return F.datediff(close, opened)


def is_long(days: Column, limit: int = 365) -> Column:
    return F.coalesce(days > limit, F.lit(False))


def has_value(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def missing_any(cols: Sequence[Column]) -> Column:
    return any_of([c.isNull() for c in cols])


def out_of_order(opened: Column, close: Column) -> Column:
    return F.coalesce(close < opened, F.lit(False))


def fuel_category(first: Column, second: Column) -> Column:
    return first_match(
        [
            (first == "Electricity", "Electric"),
            (second == "Electricity", "Plug-in Hybrid"),
            (second == "E85", "Flex-Fuel"),
            (first.contains("Diesel"), "Diesel"),
            (first.contains("Gasoline"), "Gasoline"),
        ],
        "Other",
    )


def first_metric(a: Column, b: Column, zero_is_null: bool = False) -> Column:
    """The first figure that is there; optionally a 0 counts as absent."""
    if zero_is_null:
        a = F.nullif(a, F.lit(0))
    return F.coalesce(a, b)


def is_value(c: Column, value) -> Column:
    return F.coalesce(c == value, F.lit(False))


def row_mean(cols: Sequence[Column]) -> Column:
    """Mean over the columns that are not NULL, NULL where all are."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    return F.try_divide(total, count_true([c.isNotNull() for c in cols]))


def count_true(flags: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(f, 1).otherwise(0) for f in flags])


def band(c: Column, cuts: Sequence[tuple[float, str]], rest: str, null_label: str | None = None) -> Column:
    """Label of the highest cut the value reaches; ``rest`` below all cuts."""
    return first_match(
        [(c.isNull(), F.lit(null_label))] + [(c >= low, F.lit(label)) for low, label in cuts], F.lit(rest)
    )


def safety_tier(mean: Column) -> Column:
    return band(mean, rules.SAFETY_TIERS, rules.SAFETY_TIER_REST, rules.SAFETY_TIER_NULL)


def sentiment_band(score: Column) -> Column:
    """An unknown score has no band."""
    return band(score, rules.SENTIMENT_BANDS, rules.SENTIMENT_BAND_REST)


def surrogate_key(cols: Sequence[Column]) -> Column:
    """SHA-256 over the parts joined with '_'; a NULL part leaves an empty slot."""
    return F.sha2(F.concat_ws("_", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256)


def record_id(c: Column) -> Column:
    return F.sha2(c.cast("string"), 256)
