"""Row filters and projections over whole DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from carlake import rules
from carlake.functions import cleaning as C


def _first_present(df: DataFrame, candidates: Sequence[str]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def standardize(df: DataFrame, col: str, variants=rules.MAKER_VARIANTS, out: str | None = None) -> DataFrame:
    return df.withColumn(out or f"{col}_standardized", C.standardize_name(F.col(col), variants))


def keep_names(df: DataFrame, col: str, names: Sequence[str] = rules.MAKERS) -> DataFrame:
    return df.filter(F.col(col).isin(list(names)))


def filter_names_expanded(df: DataFrame, names: Sequence[str], col: str | None = None) -> DataFrame:
    """Rows whose maker is one of the names or a known variant; the maker text is stripped, NULL as ''."""
    col = col or _first_present(df, rules.MAKE_COLUMNS)
    if col is None:
        return df
    wanted = [n.upper() for n in names]
    wanted += [v for n in wanted for v in rules.INGEST_VARIANTS.get(n, [])]
    stripped = F.regexp_replace(F.coalesce(F.col(col), F.lit("")), r"^\s+|\s+$", "")
    return df.withColumn(col, stripped).filter(F.upper(F.col(col)).isin(wanted))


def filter_years(df: DataFrame, lo: int, hi: int, col: str | None = None) -> DataFrame:
    """Rows whose year is a number in the range; adds that number as ``<col>_clean``."""
    col = col or _first_present(df, rules.YEAR_COLUMNS)
    if col is None:
        return df
    clean = f"{col}_clean"
    return df.withColumn(clean, C.to_number(F.col(col))).filter(F.col(clean).between(lo, hi))


def filter_year_window(
    df: DataFrame, col: str, lo: int, hi: int, counts: Observation | None = None
) -> DataFrame:
    """Rows inside the window. With an Observation the dropped rows are counted in the same pass."""
    inside = F.col(col).between(lo, hi)
    if counts is not None:
        df = df.observe(counts, F.count_if(~F.coalesce(inside, F.lit(False))).alias("invalid_years"))
    return df.filter(inside)


def select_available(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in wanted if c in df.columns])


def require(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull())


def to_fact(df: DataFrame, spec: Sequence[tuple[str, Column | str]]) -> DataFrame:
    """One projection to the target schema from (name, column or expression) pairs."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in spec])


def add_lineage(df: DataFrame, source: str, as_of: datetime) -> DataFrame:
    return df.select("*", *C.lineage(source, as_of))
