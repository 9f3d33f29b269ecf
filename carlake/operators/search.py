"""Time-window search over news and trade events. ``as_of`` replaces the wall clock."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carlake import rules
from carlake.functions.derived import any_of
from carlake.operators.aggregates import matched_names, since
from carlake.operators.reshape import union_all



def _mentions(term: str, *cols: str) -> Column:
    """The term occurs in one of the columns, ignoring case."""
    return any_of([F.coalesce(F.lower(c).contains(term.lower()), F.lit(False)) for c in cols])


def _newest(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(F.desc("published_date"), F.asc("article_id")).limit(limit)


def _between(value: int, lo: int, hi: int, name: str) -> None:
    if not lo <= value <= hi:
        raise ValueError(f"{name} must be between {lo} and {hi}")


def search_news(
    df: DataFrame,
    as_of: datetime,
    query: str | None = None,
    makers: Sequence[str] = (),
    category: str | None = None,
    days: int = 7,
    limit: int = 20,
    any_word: bool = False,
) -> DataFrame:
    """Articles of the last days with the phrase (or, with ``any_word``, one of its words) and any maker."""
    hits = since(df, "published_date", as_of, days=days)
    if query:
        phrases = query.split() if any_word else [query]
        hits = hits.filter(any_of([_mentions(p, "title", "summary") for p in phrases]))
    if makers:
        hits = hits.filter(any_of([_mentions(m, "title", "summary") for m in makers]))
    if category:
        hits = hits.filter(F.lower("category") == category.lower())
    return _newest(hits, limit)


def breaking(df: DataFrame, as_of: datetime, hours: int = 24, limit: int = 10) -> DataFrame:
    _between(hours, 1, 168, "hours")
    _between(limit, 1, 50, "limit")
    return _newest(since(df, "published_date", as_of, hours=hours), limit)


def news_by_maker(df: DataFrame, as_of: datetime, maker: str, days: int = 7, limit: int = 20) -> DataFrame:
    _between(days, 1, 365, "days")
    _between(limit, 1, 100, "limit")
    return search_news(df, as_of, makers=[maker], days=days, limit=limit)


def briefing(
    df: DataFrame, as_of: datetime, role: str, makers: Sequence[str] = (), any_word: bool = False
) -> DataFrame:
    """Tagged sections: 5 breaking articles, 5 for the role, 3 per focus maker."""
    wide = df.select("article_id", "title", "summary", "published_date")

    def tagged(part: DataFrame, section: str) -> DataFrame:
        return part.select(
            F.lit(section).alias("section"), F.lit(None).cast("string").alias("maker"),
            "article_id", "title", "published_date",
        )

    parts = [tagged(breaking(wide, as_of, 24, 5), "breaking_news")]
    if role in rules.ROLE_PHRASES:
        section, phrase = rules.ROLE_PHRASES[role]
        parts.append(tagged(search_news(wide, as_of, phrase, days=7, limit=5, any_word=any_word), section))
    if makers:
        # all makers in one pass; the rank limit is applied below the shuffle
        hits = since(wide, "published_date", as_of, days=7).withColumn(
            "maker", F.explode(matched_names(makers, F.col("title"), F.col("summary")))
        )
        order = Window.partitionBy("maker").orderBy(F.desc("published_date"), F.asc("article_id"))
        top = hits.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= 3)
        parts.append(
            top.select(
                F.lit("manufacturer_updates").alias("section"), "maker", "article_id", "title", "published_date"
            )
        )
    return union_all(*parts)


# --- trade events ------------------------------------------------------------------


def upcoming(df: DataFrame, as_of: datetime, days: int) -> DataFrame:
    today = as_of.date()
    return df.filter(F.col("date_start").between(F.lit(today), F.lit(today + timedelta(days=days))))


def _soonest(df: DataFrame, limit: int | None = None) -> DataFrame:
    ordered = df.orderBy(F.asc("date_start"), F.asc("event_id"))
    return ordered if limit is None else ordered.limit(limit)


def _plain(c: str) -> Column:
    """Lower case with '_' read as a space, so stored and searched spellings meet."""
    return F.translate(F.lower(c), "_", " ")


def search_events(
    df: DataFrame,
    as_of: datetime,
    event_type: str | None = None,
    location: str | None = None,
    days: int = 90,
    limit: int = 20,
) -> DataFrame:
    _between(days, 1, 730, "days")
    _between(limit, 1, 100, "limit")
    hits = upcoming(df, as_of, days)
    if event_type:
        hits = hits.filter(_plain("event_type").contains(event_type.lower().replace("_", " ")))
    if location:
        hits = hits.filter(F.lower("location").contains(location.lower()))
    return _soonest(hits, limit)


def events_by_maker(df: DataFrame, as_of: datetime, maker: str, days: int = 90) -> DataFrame:
    member = F.coalesce(F.array_contains("participating_manufacturers", maker), F.lit(False))
    return _soonest(upcoming(df, as_of, days).filter(_mentions(maker, "title", "description") | member))


def calendar(df: DataFrame, as_of: datetime, days: int = 90) -> DataFrame:
    """Upcoming events with their month key and label, in date order.

    Rows stay rows: a month may hold any number of events, so they are not gathered into one list."""
    start = F.col("date_start")
    return _soonest(
        upcoming(df, as_of, days).select(
            F.date_format(start, "yyyy-MM").alias("month_key"), F.date_format(start, "MMMM yyyy").alias("month"), "*"
        )
    )


def calendar_months(df: DataFrame, as_of: datetime, days: int = 90) -> DataFrame:
    """Number of upcoming events and first date per month."""
    months = calendar(df, as_of, days).groupBy("month_key", "month")
    return months.agg(F.count("*").alias("n"), F.min("date_start").alias("first_date"))


def events_of_type(df: DataFrame, as_of: datetime, words: Sequence[str], days: int) -> DataFrame:
    return _soonest(upcoming(df, as_of, days).filter(any_of([_plain("event_type").contains(w) for w in words])))


def auto_shows(df: DataFrame, as_of: datetime, days: int = 365) -> DataFrame:
    return events_of_type(df, as_of, ["auto show"], days)


def conferences(df: DataFrame, as_of: datetime, days: int = 180) -> DataFrame:
    return events_of_type(df, as_of, ["conference", "congress", "summit"], days)


# --- response shape ------------------------------------------------------------------


def iso_text(c: str, kind: str) -> Column:
    """ISO text of a date or timestamp; a fraction of a second shows only if there is one."""
    if kind == "date":
        return F.date_format(c, "yyyy-MM-dd")
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(c, ".SSSSSS")
    return F.concat(whole, F.when(fraction != ".000000", fraction).otherwise(F.lit("")))


def format_rows(df: DataFrame, scores: Sequence[str] = ("importance_score", "relevance_score")) -> DataFrame:
    """Dates as ISO text, scores as double; a score of 0 reads as absent."""
    kinds = dict(df.dtypes)

    def shaped(name: str) -> Column:
        kind = kinds[name]
        if kind == "date" or kind.startswith("timestamp"):
            return iso_text(name, "date" if kind == "date" else "timestamp").alias(name)
        if name in scores:
            return F.nullif(F.col(name).cast("double"), F.lit(0.0)).alias(name)
        return F.col(name)

    return df.select(*[shaped(c) for c in df.columns])
