"""Raw schemas. Raw files are read as text; the cleaning expressions give the types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql.types import StringType, StructField, StructType

from carlake import rules


def text_schema(names: Sequence[str]) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


COMPLAINTS_RAW = text_schema(rules.COMPLAINT_FIELDS)
INVESTIGATIONS_RAW = text_schema(rules.INVESTIGATION_FIELDS)
RATINGS_RAW = text_schema(rules.RATING_FIELDS)
FUEL_RAW = text_schema([column for column, _ in rules.VEHICLE_TAGS.values()])
SERIES_RAW = text_schema(["date", "value", "series_id", "series_name"])
RECALLS_RAW = text_schema(["recall_id", "make", "model", "year", "summary", "document_type", "document_url"])

ARTICLE_DDL = (
    "title string, url string, published_date timestamp_ntz, source string, author string, summary string, "
    "category string, sentiment string, importance_score int, mentioned_manufacturers array<string>, "
    "mentioned_models array<string>, mentioned_executives array<string>, mentioned_locations array<string>, "
    "is_breaking_news boolean, is_recall_related boolean, is_safety_critical boolean, scraped_at timestamp_ntz"
)
RAW_ARTICLE_DDL = "title string, url string, published_date timestamp_ntz, source string, author string, summary string"
RAW_EVENT_DDL = "title string, url string, block_text string"
EVENT_DDL = (
    "title string, url string, event_type string, description string, date_start date, date_end date, "
    "date_raw string, location string, is_virtual boolean, key_topics array<string>, "
    "participating_manufacturers array<string>, relevance_score double, strategic_importance string, "
    "source string, scraped_at timestamp_ntz"
)
