"""The documented analytic questions over the six facts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carlake.operators.aggregates import n_largest, top_n
from carlake.operators.joins import join_vehicle, make_scorecard


def _count_by(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(name)).orderBy(F.desc(name), F.asc(key))


def open_investigations(investigations: DataFrame) -> DataFrame:
    is_open = F.col("investigation_status").isin("OPEN", "Open", "open")
    return _count_by(investigations.filter(is_open), "make", "open_count")


def recalled_components(investigations: DataFrame) -> DataFrame:
    return _count_by(investigations.filter("has_recall"), "component_name", "recall_count")


def investigations_per_year(investigations: DataFrame) -> DataFrame:
    return investigations.groupBy(F.year("open_date").alias("year")).agg(F.count("*").alias("n")).orderBy("year")


def mean_stars(ratings: DataFrame, key: str) -> DataFrame:
    return ratings.groupBy(key).agg(F.avg("overall_stars").alias("avg_stars"))


def safest_vehicles(ratings: DataFrame) -> DataFrame:
    return ratings.filter((F.col("overall_stars") >= 5.0) & F.col("has_advanced_safety"))


def crashes_per_make(complaints: DataFrame) -> DataFrame:
    return _count_by(complaints.filter("crash_flag"), "make", "crash_count")


def level_distribution(complaints: DataFrame, col: str) -> DataFrame:
    return _count_by(complaints, col, "n")


def sentiment_ranking(complaints: DataFrame) -> DataFrame:
    """Mean sentiment per make, worst first."""
    means = complaints.groupBy("make").agg(F.round(F.avg("sentiment_score"), 3).alias("avg_sentiment"))
    return means.orderBy("avg_sentiment", "make")


def safety_critical(complaints: DataFrame, make: str | None = None, limit: int | None = None) -> DataFrame:
    hits = complaints.filter((F.col("sentiment_category") == "VERY_NEGATIVE") & (F.col("safety_keyword_count") >= 3))
    if make:
        hits = hits.filter(F.col("make") == make)
    return hits if limit is None else top_n(hits, [F.asc("complaint_id")], limit)


def very_negative_per_make(complaints: DataFrame) -> DataFrame:
    return _count_by(complaints.filter(F.col("sentiment_category") == "VERY_NEGATIVE"), "make", "very_neg_count")


def top_recall_makes(recalls: DataFrame, n: int = 10) -> DataFrame:
    return _count_by(recalls, "make", "recall_count").limit(n)


def recalls_of_make(recalls: DataFrame, make: str) -> DataFrame:
    of_make = recalls.filter(F.col("make") == make)
    return of_make.groupBy("year").agg(F.count("*").alias("recall_count")).orderBy(F.desc("year"))


def mean_mpg_per_make(fuel: DataFrame, n: int = 10) -> DataFrame:
    means = fuel.groupBy("make").agg(F.avg("mpg_combined").alias("avg_mpg"))
    return top_n(means, [F.desc("avg_mpg"), F.asc("make")], n)


def mpg_trend(fuel: DataFrame) -> DataFrame:
    """Mean mpg per year of vehicles that are not electric."""
    return fuel.filter(~F.col("is_electric")).groupBy("year").agg(F.avg("mpg_combined").alias("avg_mpg"))


def electric_by_range(fuel: DataFrame, n: int | None = None) -> DataFrame:
    if n is not None:
        return n_largest(fuel, "electric_range", n, F.col("is_electric"), ["fuel_economy_id"])
    return fuel.filter("is_electric").orderBy(F.desc("electric_range"), "fuel_economy_id")


def latest_months(economic: DataFrame, n: int = 12) -> DataFrame:
    return top_n(economic, [F.desc("date")], n)


def yearly_sales(economic: DataFrame) -> DataFrame:
    return economic.groupBy(F.year("date").alias("year")).agg(F.avg("total_vehicle_sales").alias("avg_sales"))


def sales_since(economic: DataFrame, year: int = 2020) -> DataFrame:
    return economic.filter(F.col("date") >= F.lit(date(year, 1, 1)).cast(economic.schema["date"].dataType)).select("date", "total_vehicle_sales").orderBy("date")


def sentiment_trend(complaints: DataFrame, make: str) -> DataFrame:
    of_make = complaints.filter(F.col("make") == make)
    return of_make.groupBy("year").agg(F.avg("sentiment_score").alias("avg_sentiment"), F.count("*").alias("n"))


def compare_sentiment(complaints: DataFrame, makes: Sequence[str]) -> DataFrame:
    chosen = complaints.filter(F.col("make").isin(list(makes)))
    return chosen.groupBy("make").agg(F.avg("sentiment_score").alias("avg_sentiment"), F.count("*").alias("n"))


def sentiment_by_drive(complaints: DataFrame, fuel: DataFrame) -> DataFrame:
    """Complaint sentiment of electric against other vehicles.

    A vehicle has one fuel row per variant, so the fuel side is reduced to one flag per vehicle first.
    The complaints are summed per vehicle before the join: what meets is one row per vehicle on both
    sides, whatever share of all complaints one vehicle has."""
    flags = fuel.groupBy("vehicle_id").agg(F.max("is_electric").alias("is_electric"))
    sums = complaints.groupBy("vehicle_id").agg(
        F.sum("sentiment_score").alias("_sum"), F.count("sentiment_score").alias("_scored"), F.count("*").alias("_n")
    )
    joined = join_vehicle(sums, flags)
    return joined.groupBy("is_electric").agg(
        F.try_divide(F.sum("_sum"), F.sum("_scored")).alias("avg_sentiment"), F.sum("_n").alias("n")
    )


def scorecard(recalls: DataFrame, ratings: DataFrame, complaints: DataFrame) -> DataFrame:
    return make_scorecard(recalls, ratings, complaints)
