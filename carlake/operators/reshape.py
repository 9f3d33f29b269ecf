"""Keep-one, pivot, label, explode and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the least by ``order`` and then by all other columns; NULL keys are equal.

    It is the minimum of a struct, so every map task keeps one row per key before the shuffle and a key
    that holds a large share of all rows costs no more than any other."""
    order = [c for c in (order or []) if c not in keys]
    rest = order + [c for c in df.columns if c not in keys and c not in order]
    if not rest:
        return df.select(*keys).distinct()
    kept = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row"))
    return kept.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def dedup_documents(df: DataFrame, key: str, kind: str, primary: Sequence[str]) -> DataFrame:
    """One row per recall out of one row per document: the document whose kind comes first in ``primary``
    wins; ``document_count`` tells how many there were."""
    ranks = F.create_map(*[F.lit(x) for x in chain.from_iterable((k, i) for i, k in enumerate(primary))])
    rank = F.coalesce(F.try_element_at(ranks, F.col(kind)), F.lit(len(primary)))
    rest = [c for c in df.columns if c != key]
    kept = df.groupBy(key).agg(
        F.min(F.struct(rank.alias("_rank"), *rest)).alias("_row"), F.count("*").alias("document_count")
    )
    return kept.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest], "document_count")


def pivot_series(
    df: DataFrame, key: str | Column, name: str, value: str, names: Mapping[str, str]
) -> DataFrame:
    """Long to wide: one column per named series, the maximum where a cell has several values.

    The names are given, so no job runs to find them; the plan is one partial aggregation and one shuffle."""
    cells = [F.max(F.when(F.col(name) == n, F.col(value))).alias(out) for n, out in names.items()]
    return df.groupBy(key).agg(*cells)


def label(c: Column, names: Mapping[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(names.items())]), c)


def explode_mentions(df: DataFrame, col: str, out: str = "mention") -> DataFrame:
    return df.withColumn(out, F.explode(col))


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def array_union_all(*cols: Column) -> Column:
    """Distinct elements of all arrays, sorted."""
    return F.array_sort(F.array_distinct(F.concat(*[F.coalesce(c, F.array()) for c in cols])))
