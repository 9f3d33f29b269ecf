"""Tagging of raw articles and trade events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carlake.functions import text as T
from carlake.session import spread


def tag_articles(
    df: DataFrame,
    as_of: datetime,
    keep: Sequence[str] = (),
    summary_chars: int | None = None,
    mentions: Mapping[str, int] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Article records from title, url, published_date, source, author and the summary.

    The whole summary is tagged: ``full_summary`` where the input has one, as feeds do, else ``summary``. All
    mentions are kept, and the summary is whole, unless ``mentions`` (makers, models, people, places) or ``summary_chars``
    say how much to keep."""
    cut = mentions or {}
    df = df.withColumn("summary", F.col("full_summary")) if "full_summary" in df.columns else df
    df = spread(df, parts).select("*", F.concat_ws(" ", F.col("title"), F.coalesce("summary", F.lit(""))).alias("_text"))
    df = df.select("*", F.lower("_text").alias("_low"))
    low, text = F.col("_low"), F.col("_text")
    df = df.select("*", T.news_category(low).alias("category"), T.is_breaking(low).alias("is_breaking_news"))
    return df.select(
        "title", "url", "published_date", "source", "author",
        _first_chars("summary", summary_chars), "category",
        T.news_sentiment(low).alias("sentiment"),
        T.importance(low, F.col("category"), F.col("is_breaking_news")).alias("importance_score"),
        T.extract_makers(text, cut.get("makers")).alias("mentioned_manufacturers"),
        T.extract_models(text, cut.get("models")).alias("mentioned_models"),
        T.extract_people(text, cut.get("people")).alias("mentioned_executives"),
        T.extract_places(text, cut.get("places")).alias("mentioned_locations"),
        "is_breaking_news",
        (F.col("category") == "recalls").alias("is_recall_related"),
        T.is_safety_critical(low).alias("is_safety_critical"),
        F.lit(as_of).cast("timestamp_ntz").alias("scraped_at"),
        *keep,
    )


def _first_chars(c: str, n: int | None) -> Column:
    return F.col(c) if n is None else F.substring(c, 1, n).alias(c)


def tag_events(
    df: DataFrame,
    as_of: datetime,
    source: str = "events_page",
    raw_chars: int | None = None,
    makers: int | None = None,
    parts: int | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Trade-event records from title, url and block_text. ``raw_chars`` and ``makers`` cut date_raw and the makers.
    ``keep`` names further columns to carry along."""
    df = T.with_event_dates(df, "block_text", parts).select("*", F.concat_ws(" ", "title", "block_text").alias("_text"))
    df = df.select("*", F.lower("_text").alias("_low"))
    df = df.select(
        "*", T.event_place(F.col("block_text")).alias("location"), T.event_topics(F.col("_low")).alias("key_topics"),
    )
    df = df.select("*", T.relevance(F.col("date_start"), F.col("key_topics"), F.col("location")).alias("_relevance"))
    return df.select(
        "title", "url", T.event_type(F.col("_low")).alias("event_type"), F.lit("").alias("description"),
        "date_start", "date_end", _first_chars("block_text", raw_chars).alias("date_raw"), "location",
        T.is_virtual(F.lower("block_text")).alias("is_virtual"), "key_topics",
        T.extract_makers(F.col("_text"), makers).alias("participating_manufacturers"),
        F.round("_relevance", 2).alias("relevance_score"),
        T.strategic_importance(F.col("_relevance")).alias("strategic_importance"),
        F.lit(source).alias("source"), F.lit(as_of).cast("timestamp_ntz").alias("scraped_at"),
        *keep,
    )
