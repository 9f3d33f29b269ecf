"""Aggregations, ordering and limits. Every group is reduced map-side before its shuffle."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from carlake.functions.text import bind


def distribution(df: DataFrame, *cols: str) -> DataFrame:
    counts = df.groupBy(*cols).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), *[F.asc(c) for c in cols])


def count_by_year(df: DataFrame, year: str = "year") -> DataFrame:
    return df.groupBy(year).agg(F.count("*").alias("n")).orderBy(year)


def quality_stats(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row with the number of rows that meet each condition."""
    return df.agg(*[F.count_if(cond).alias(name) for name, cond in conditions.items()])


def run_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before and after a step, rows removed and the share kept, as one row."""
    counts = before.agg(F.count("*").alias("initial_rows")).select(
        "initial_rows", after.agg(F.count("*")).scalar().alias("final_rows")
    )
    initial, final = F.col("initial_rows"), F.col("final_rows")
    return counts.select(
        "initial_rows",
        "final_rows",
        (initial - final).alias("removed_rows"),
        F.round(F.try_divide(final * 100, initial), 1).alias("retention_pct"),
    )


def summarize_step(df: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """As ``run_summary`` of a table before and after a step, in one pass: rows are counted on their way into the step."""
    seen = Observation()
    final = step(df.observe(seen, F.count(F.lit(1)).alias("rows"))).agg(F.count("*")).first()[0]
    initial = seen.get["rows"]
    counts = df.sparkSession.range(1).select(F.lit(initial).cast("long").alias("a"), F.lit(final).cast("long").alias("b"))
    return counts.select(
        F.col("a").alias("initial_rows"), F.col("b").alias("final_rows"), (F.col("a") - F.col("b")).alias("removed_rows"),
        F.round(F.try_divide(F.col("b") * 100, F.col("a")), 1).alias("retention_pct"),
    )


def describe(df: DataFrame, col: str) -> DataFrame:
    return df.agg(
        F.count(col).alias("n"),
        F.avg(col).alias("mean"),
        F.stddev(col).alias("stddev"),
        F.min(col).alias("min"),
        F.max(col).alias("max"),
    )


def date_range(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.min(col).alias("first_date"), F.max(col).alias("last_date"))


def avg_by(
    df: DataFrame, key: str, value: str, where: Column | None = None, digits: int | None = None
) -> DataFrame:
    if where is not None:
        df = df.filter(where)
    mean = F.avg(value)
    mean = mean if digits is None else F.round(mean, digits)
    return df.groupBy(key).agg(mean.alias("mean"), F.count(value).alias("n"))


def share(df: DataFrame, key: str) -> DataFrame:
    """Count and share of the total per key. The total is a scalar subquery over the group counts,
    so no window pulls all groups into one task."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(key, "n", (F.col("n") * 100.0 / total).alias("pct"))


def n_distinct(df: DataFrame, *cols: str) -> DataFrame:
    return df.agg(*[F.count_distinct(F.col(c)).alias(f"{c}_distinct") for c in cols])


def avg_by_year(df: DataFrame, date: str, value: str) -> DataFrame:
    return df.groupBy(F.year(date).alias("year")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def having(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(condition)


def matched_names(names: Sequence[str], *texts: Column) -> Column:
    """The names that occur in any of the texts, ignoring case."""
    listed = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(n.lower()).alias("low")) for n in names])
    # the texts are joined by a line break, which no name contains
    text = F.lower(F.concat_ws("\n", *texts))
    return bind(text, lambda t: F.filter(listed, lambda n: t.contains(n["low"])))["name"]


def since(df: DataFrame, date: str, as_of: datetime, **back: int) -> DataFrame:
    """Rows not older than ``back`` before ``as_of``.

    The bound is a literal of the column's own type, so the filter reaches the scan."""
    bound = F.lit(as_of - timedelta(**back)).cast(df.schema[date].dataType)
    return df.filter(F.col(date) >= bound)


def sentiment_mix(df: DataFrame, names: Sequence[str], days: int, as_of: datetime) -> DataFrame:
    """Articles and mean importance per maker and label in a look-back window, with the maker's total."""
    hits = since(df, "published_date", as_of, days=days).select(
        F.explode(matched_names(names, F.col("title"), F.col("summary"))).alias("maker"),
        "sentiment",
        "importance_score",
    )
    per_label = hits.groupBy("maker", "sentiment").agg(
        F.count("*").alias("n"), F.avg("importance_score").alias("avg_importance")
    )
    # at most len(names) x labels rows are left here
    total = F.sum("n").over(Window.partitionBy("maker"))
    return per_label.select("maker", "sentiment", "n", "avg_importance", total.alias("total_articles"))


def compare_makers(
    df: DataFrame, names: Sequence[str], days: int, as_of: datetime, cap: int | None = None, newest: int = 5
) -> DataFrame:
    """Per maker: mentions, label counts, mean importance and newest titles; of its ``cap`` newest articles if given.

    Counts are aggregated map-side. The rank limits of ``cap`` and ``newest`` are applied before the shuffle too, so a maker
    mentioned everywhere sends that many rows per map task. An importance of 0 counts as unknown."""
    hits = since(df, "published_date", as_of, days=days).select(
        F.explode(matched_names(names, F.col("title"), F.col("summary"))).alias("maker"),
        "article_id", "title", "published_date", "sentiment", "importance_score",
    )
    newest_first = Window.partitionBy("maker").orderBy(F.desc("published_date"), F.asc("article_id"))
    ranked = hits.withColumn("rank", F.row_number().over(newest_first))
    label = F.lower("sentiment")
    recent = F.sort_array(F.collect_list(F.struct("rank", "title")))
    titles = ranked.filter(F.col("rank") <= newest).groupBy("maker").agg(
        F.transform(recent, lambda r: r["title"]).alias("recent_titles")
    )
    counts = (hits if cap is None else ranked.filter(F.col("rank") <= cap)).groupBy("maker").agg(
        F.count("*").alias("total_mentions"),
        *[F.count_if(label == s).alias(s) for s in ("positive", "neutral", "negative")],
        F.coalesce(F.avg(F.nullif(F.col("importance_score"), F.lit(0))), F.lit(0.0)).alias("avg_importance"),
    )
    return counts.join(titles, "maker")  # one row per name on both sides


def top_mentions(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    counts = df.select(F.explode(col).alias("mention")).groupBy("mention").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc("mention")).limit(n)


def status_counts(df: DataFrame, user: str, status: str = "status") -> DataFrame:
    states = ["pending", "approved", "rejected"]
    return df.groupBy(user).agg(
        F.count("*").alias("total"), *[F.count_if(F.col(status) == s).alias(s) for s in states]
    )


# --- order and limit -------------------------------------------------------------


def top_n(df: DataFrame, keys: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*keys).limit(n)


def n_largest(df: DataFrame, col: str, n: int, where: Column | None = None, ties: Sequence[str] = ()) -> DataFrame:
    if where is not None:
        df = df.filter(where)
    return df.orderBy(F.desc_nulls_last(col), *[F.asc(t) for t in ties]).limit(n)


def order_nulls_last(df: DataFrame, col: str, *ties: str) -> DataFrame:
    return df.orderBy(F.asc_nulls_last(col), *ties)


def capped(df: DataFrame, order: Sequence[Column], n: int = 100) -> DataFrame:
    """The first ``n`` rows and whether the result is cut.

    Each partition keeps its first ``n+1`` rows, so the one final task sees a bounded number."""
    first = df.orderBy(*order).limit(n + 1)
    cut = first.agg(F.count("*") > n).scalar()
    return first.limit(n).withColumn("truncated", cut)


def top_k_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows per key; the rank limit is pushed below the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
