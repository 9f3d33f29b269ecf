"""Joins across facts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carlake import rules


def make_scorecard(
    recalls: DataFrame, ratings: DataFrame, complaints: DataFrame, lo: int = 2015, hi: int = 2025, n: int = 20
) -> DataFrame:
    """Recall count, mean stars, mean sentiment and complaint count per maker of the recall fact.

    Each fact is reduced to one row per maker before the join. Joining first would multiply every maker's
    recalls, ratings and complaints with each other; the result is the same because distinct counts and
    means do not change when all rows of a group are repeated equally often. A maker with several
    spellings in the recall fact keeps one row per spelling."""
    key = F.upper("make")
    by_make = (
        recalls.filter(F.col("year").between(lo, hi))
        .groupBy("make")
        .agg(F.count_distinct("recall_id").alias("recall_count"))
        .filter(F.col("recall_count") > 0)
        .withColumn("_key", key)
    )
    stars = ratings.groupBy(key.alias("_key")).agg(F.avg("overall_stars").alias("avg_rating"))
    feelings = complaints.groupBy(key.alias("_key")).agg(
        F.avg("sentiment_score").alias("avg_sentiment"),
        F.count_distinct("complaint_id").alias("complaint_count"),
    )
    joined = by_make.join(stars, "_key", "left").join(feelings, "_key", "left")
    return (
        joined.select(
            "make", "recall_count", "avg_rating", "avg_sentiment",
            F.coalesce("complaint_count", F.lit(0)).alias("complaint_count"),
        )
        .orderBy(F.desc("recall_count"), "make")
        .limit(n)
    )


def inner_count(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of the inner join per key, without building them: the product of the two counts.

    A key that is frequent on both sides costs two counters instead of all its pairs."""
    left = a.groupBy(key).agg(F.count("*").alias("_a"))
    right = b.groupBy(key).agg(F.count("*").alias("_b"))
    return left.join(right, key).select(key, (F.col("_a") * F.col("_b")).alias("n"))


def join_vehicle(
    a: DataFrame, b: DataFrame, on: str | Sequence[str] = "vehicle_id", how: str = "inner", salts: int = 1
) -> DataFrame:
    """Equi join on the shared vehicle key, or on make and year.

    No side is hinted: adaptive execution broadcasts what it has measured to be small and splits skewed
    partitions. Else both sides shuffle; with ``salts`` > 1
    each key is spread over that many buckets: rows of ``a`` take one bucket each, rows of ``b`` are
    repeated in all of them. Right for inner and left joins, where every row of ``a`` meets its key once.
    A salted join asks for the merge: the planner takes the repeated side for as small as it was before it was repeated
    and would broadcast it through the driver."""
    on = [on] if isinstance(on, str) else list(on)
    if salts <= 1:
        return a.join(b, on, how)
    if how not in ("inner", "left"):
        raise ValueError("salted joins are inner or left")
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in a.columns]), F.lit(salts)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    joined = a.withColumn("_salt", spread).join(b.withColumn("_salt", copies).hint("merge"), [*on, "_salt"], how)
    return joined.drop("_salt")


def metadata_join(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Columns with the row count of their table, matched by schema and table name.

    A table without columns keeps one row."""
    keys = ["schema_name", "table_name"]
    return tables.select(*keys, "row_count").join(columns, keys, "left")


def unknown_refs(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    """References that name no table of the catalog, with or without its schema.

    ``refs.table_ref`` holds upper-case names; ``catalog`` has ``schema_name`` and ``table_name``."""
    known = catalog.select(F.explode(
        F.array(
            F.upper("table_name"), F.concat_ws(".", F.upper("schema_name"), F.upper("table_name"))
        )
    ).alias("table_ref")).distinct()
    return refs.join(known, "table_ref", "left_anti")


def apply_thresholds(
    df: DataFrame, tier: str, limits: Mapping[str, tuple] = rules.APPROVAL_LIMITS, default: str = "analyst"
) -> DataFrame:
    """Adds the tier's limits; an unknown tier gets the default ones. The executive has none.

    The limits are a handful of literals, so they become expressions and no join is needed."""

    def limit(i: int) -> Column:
        out = F
        for name, values in limits.items():
            if name != default:
                out = out.when(F.col(tier) == name, F.lit(float(values[i])))
        out = out.when(F.col(tier) == "executive", F.lit(float("inf")))
        return out.otherwise(F.lit(float(limits[default][i])))

    return df.select(
        "*", limit(0).alias("max_cost"), limit(1).alias("max_rows"), limit(2).alias("max_tables")
    )
