"""Q operators: time-window search over news and trade events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from carlake.operators import search as Q
from carlake.operators.textindex import candidates, write_index
from carlake.session import new_path
from checks.registry import query

NEWS_AS_OF = datetime(2024, 1, 31)
EVENTS_AS_OF = datetime(1998, 1, 1)
COLS = ["article_id", "title", "published_date", "summary", "category"]
SELECT = "SELECT " + ", ".join(COLS) + " FROM {articles} WHERE published_date >= TIMESTAMP '2024-01-31' - INTERVAL "
NEWEST = " ORDER BY published_date DESC, article_id LIMIT "


def says(word: str) -> str:
    return f"(contains(lower(title), '{word}') OR contains(lower(summary), '{word}'))"


@query(
    "Q01_search_news",
    SELECT + f"10 DAY AND {says('battery plant')} AND ({says('ford')} OR {says('honda')}) AND category = 'ev'" + NEWEST + "20",
)
def _(t):
    hits = Q.search_news(t("articles"), NEWS_AS_OF, "Battery plant", ["Ford", "Honda"], "EV", days=10)
    return hits.select(*COLS)


@query(
    "Q01_search_index",
    SELECT + f"10 DAY AND {says('battery plant')} AND ({says('ford')} OR {says('honda')}) AND category = 'ev'" + NEWEST + "20",
)
def _(t):
    path = new_path(t.spark, "articles")
    write_index(t("articles"), path, ["title", "summary"], F.to_date("published_date"))
    rows, _read = candidates(t.spark, path, all_of=["Battery plant"], any_of=["Ford", "Honda"])
    return Q.search_news(rows, NEWS_AS_OF, "Battery plant", ["Ford", "Honda"], "EV", days=10).select(*COLS)


@query("Q02_breaking", SELECT + "120 HOUR" + NEWEST + "10")
def _(t):
    return Q.breaking(t("articles"), NEWS_AS_OF, hours=120).select(*COLS)


@query("Q03_news_by_maker", SELECT + f"7 DAY AND {says('kia')}" + NEWEST + "20")
def _(t):
    return Q.news_by_maker(t("articles"), NEWS_AS_OF, "Kia").select(*COLS)


EVENT_COLS = ["event_id", "title", "event_type", "date_start", "date_end", "location"]
UPCOMING = (
    "SELECT " + ", ".join(EVENT_COLS) + " FROM {trade_events} WHERE date_start BETWEEN DATE '1998-01-01' AND DATE '1998-01-01' + "
)


@query(
    "Q04_search_events",
    UPCOMING + "90 AND event_type = 'auto_show' AND lower(location) LIKE '%detroit%' ORDER BY date_start, event_id LIMIT 20",
)
def _(t):
    return Q.search_events(t("trade_events"), EVENTS_AS_OF, "auto show", "Detroit").select(*EVENT_COLS)


@query(
    "Q05_events_by_maker",
    UPCOMING + """90 AND (contains(lower(title), 'ford') OR contains(lower(description), 'ford')
    OR list_contains(participating_manufacturers, 'Ford'))""",
)
def _(t):
    return Q.events_by_maker(t("trade_events"), EVENTS_AS_OF, "Ford").select(*EVENT_COLS)


@query(
    "Q06_calendar",
    """SELECT strftime(date_start, '%Y-%m') AS month_key, strftime(date_start, '%B %Y') AS month, event_id, title, date_start
    FROM {trade_events} WHERE date_start BETWEEN DATE '1998-01-01' AND DATE '1998-01-01' + 90""",
)
def _(t):
    return Q.calendar(t("trade_events"), EVENTS_AS_OF).select("month_key", "month", "event_id", "title", "date_start")


@query(
    "Q06_calendar_months",
    """SELECT strftime(date_start, '%Y-%m') AS month_key, strftime(date_start, '%B %Y') AS month, count(*) AS n,
    min(date_start) AS first_date FROM {trade_events}
    WHERE date_start BETWEEN DATE '1998-01-01' AND DATE '1998-01-01' + 365 GROUP BY 1, 2""",
)
def _(t):
    return Q.calendar_months(t("trade_events"), EVENTS_AS_OF, 365)


@query("Q07_auto_shows", UPCOMING + "365 AND event_type = 'auto_show'")
def _(t):
    return Q.auto_shows(t("trade_events"), EVENTS_AS_OF).select(*EVENT_COLS)


@query("Q08_conferences", UPCOMING + "180 AND event_type IN ('conference', 'Congress', 'tech_summit')")
def _(t):
    return Q.conferences(t("trade_events"), EVENTS_AS_OF).select(*EVENT_COLS)


WEEK = "FROM {articles} WHERE published_date >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY"
BRIEFING = f"""
(SELECT 'breaking_news' AS section, NULL::VARCHAR AS maker, article_id, title, published_date FROM {{articles}}
  WHERE published_date >= TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR ORDER BY published_date DESC, article_id LIMIT 5)
UNION ALL (SELECT 'market_analysis', NULL, article_id, title, published_date {WEEK} AND ROLE
  ORDER BY published_date DESC, article_id LIMIT 5)
UNION ALL (SELECT 'manufacturer_updates', maker, article_id, title, published_date FROM (SELECT *, row_number() OVER (
    PARTITION BY maker ORDER BY published_date DESC, article_id) AS r
  FROM (SELECT * {WEEK}) JOIN (VALUES ('Ford'), ('Kia')) m(maker)
    ON contains(lower(title), lower(maker)) OR contains(lower(summary), lower(maker))) WHERE r <= 3)"""


@query("Q09_briefing", BRIEFING.replace("ROLE", says("sales market share revenue")))
def _(t):
    return Q.briefing(t("articles"), NEWS_AS_OF, "analyst", ["Ford", "Kia"])


@query(
    "Q09_briefing_any_word",
    BRIEFING.replace("ROLE", "(" + " OR ".join(says(w) for w in ("sales", "market", "share", "revenue")) + ")"),
)
def _(t):
    return Q.briefing(t("articles"), NEWS_AS_OF, "analyst", ["Ford", "Kia"], any_word=True)


@query(
    "Q10_format_rows",
    """SELECT article_id, title, strftime(published_date, '%Y-%m-%dT%H:%M:%S') ||
    CASE WHEN microsecond(published_date) % 1000000 = 0 THEN '' ELSE strftime(published_date, '.%f') END AS published_date,
    nullif(CAST(importance_score AS DOUBLE), 0) AS importance_score FROM {articles}""",
)
def _(t):
    return Q.format_rows(t("articles").select("article_id", "title", "published_date", "importance_score"))


@query(
    "Q10_format_events",
    """SELECT event_id, strftime(date_start, '%Y-%m-%d') AS date_start, strftime(date_end, '%Y-%m-%d') AS date_end,
    nullif(relevance_score, 0) AS relevance_score FROM {trade_events}""",
)
def _(t):
    return Q.format_rows(t("trade_events").select("event_id", "date_start", "date_end", "relevance_score"))
