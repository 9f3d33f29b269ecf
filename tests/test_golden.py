"""Dates, types and relevance of trade events as published, and a month of economic series."""

from datetime import date, datetime

import pytest

from carlake.plans.facts import clean_economic
from carlake.plans.news import tag_events

# title, text between title and footer, start, end, type, relevance, importance
EVENTS = [
    ("Canada Congress", "Feb. 12, 2026", date(2026, 2, 12), None, "conference", 0.7, "medium"),
    ("Congress", "Sept. 10-11, 2025", date(2025, 1, 1), None, "conference", 0.7, "medium"),
    ("Europe Congress", "Tentatively expected to take place in early June 2026", date(2026, 1, 1), None, "conference", 0.7, "medium"),
    ("Leading Women Conference", "May 20, 2025", date(2025, 5, 20), None, "conference", 0.8, "high"),
    ("Canada Retail Forum", "October 14, 2025", date(2025, 10, 14), None, "forum", 0.8, "high"),
    ("Canada Leading Women Roundtable", "Nov. 15, 2024", date(2024, 11, 15), None, "forum", 0.8, "high"),
    ("Japan Mobility Show", "Media days October 2025", date(2025, 1, 1), None, "event", 0.7, "medium"),
    ("Los Angeles auto show", "Media day Nov. 20, 2025", date(2025, 11, 20), None, "auto_show", 0.7, "medium"),
    ("Munich auto show", "The next Munich show will be in September 2027", date(2027, 1, 1), None, "auto_show", 0.8, "high"),
    ("New York auto show", "Media days April 16-17, 2025", date(2025, 4, 16), date(2025, 4, 17), "auto_show", 0.7, "medium"),
    ("Chicago auto show", "Media days Feb. 6-7, 2025", date(2025, 2, 6), date(2025, 2, 7), "auto_show", 0.7, "medium"),
    ("Toronto auto show", "Feb. 14-23, 2025", date(2025, 2, 14), date(2025, 2, 23), "auto_show", 0.7, "medium"),
    ("NADA Show", "Jan. 23-26, 2025", date(2025, 1, 23), date(2025, 1, 26), "event", 0.7, "medium"),
    ("CES", "Jan. 7-10, 2025", date(2025, 1, 7), date(2025, 1, 10), "event", 0.7, "medium"),
    ("Detroit auto show", "Media day Jan. 10, 2025", date(2025, 1, 10), None, "auto_show", 0.7, "medium"),
    ("Beijing auto show", "The next Beijing auto show will be in 2026", date(2026, 1, 1), None, "auto_show", 0.7, "medium"),
    ("Paris auto show", "Oct. 12-18, 2026", date(2026, 10, 12), date(2026, 10, 18), "auto_show", 0.7, "medium"),
    ("Geneva auto show", "The event will no longer take place", None, None, "auto_show", 0.5, "low"),
]


def test_events(spark):
    rows = [(t, "u", f"EVENT\n\n\xa0\n{t}\n\n{d}\n\nCOMPLETE COVERAGE") for t, d, *_ in EVENTS]
    df = tag_events(spark.createDataFrame(rows, "title string, url string, block_text string"), datetime(2026, 1, 1))
    got = {r["title"]: r for r in df.collect()}
    for title, _, start, end, kind, relevance, importance in EVENTS:
        row = got[title]
        assert (row["date_start"], row["date_end"]) == (start, end), title
        assert (row["event_type"], row["relevance_score"], row["strategic_importance"]) == (kind, relevance, importance), title
    assert got["Munich auto show"]["location"] == "September"
    assert got["CES"]["participating_manufacturers"] == ["CES"]
    assert got["Canada Retail Forum"]["key_topics"] == ["dealership"]


def test_first_month(spark):
    rows = [("2015-01-01", "16.91", "TOTALSA"), ("2015-01-01", "16.474", "ALTSALES"), ("2015-01-01", "5.462", "DAUTOSAAR")]
    wide = clean_economic(spark.createDataFrame(rows, "date string, value string, series_id string"), datetime(2026, 1, 1))
    row = wide.first()
    assert row["date"] == date(2015, 1, 1)
    assert [row[c] for c in ("total_vehicle_sales", "light_truck_sales", "domestic_auto_sales")] == [
        pytest.approx(16.91), pytest.approx(16.474), pytest.approx(5.462)
    ]
