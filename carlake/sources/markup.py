"""XML, RSS and HTML."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carlake import rules
from carlake.functions.cleaning import squeeze, strip_tags


def _text(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


VEHICLE_MEASURES = ["year", "charge_time_240v_hours", *(name for name, default in rules.VEHICLE_TAGS.values() if default == "0")]
VEHICLE_SCHEMA = ", ".join(f"`{tag}` string" for tag in rules.VEHICLE_TAGS)


def _vehicle_columns(prefix: str = "") -> list[Column]:
    return [
        F.coalesce(_text(F.col(f"{prefix}`{tag}`")), F.lit(default)).alias(name)
        for tag, (name, default) in rules.VEHICLE_TAGS.items()
    ]


def read_vehicle_xml(spark: SparkSession, path) -> DataFrame:
    """One row per ``vehicle`` element of XML files: the 31 known tags, each with its default when empty."""
    raw = spark.read.format("xml").option("rowTag", "vehicle").schema(VEHICLE_SCHEMA).load(path)
    return raw.select(*_vehicle_columns())


def parse_vehicle_xml(df: DataFrame, xml_col: str) -> DataFrame:
    """The same columns where every row holds one vehicle document, as responses are stored; such
    files are split by line, so one large file is read by many tasks."""
    parsed = df.select(F.from_xml(F.col(xml_col), VEHICLE_SCHEMA).alias("v"))
    return parsed.select(*_vehicle_columns("v."))


def vehicle_numbers(df: DataFrame) -> DataFrame:
    """The measures of vehicle records as numbers; text that is none becomes NULL."""
    return df.select(*[F.col(c).try_cast("double").alias(c) if c in VEHICLE_MEASURES else F.col(c) for c in df.columns])


def explode_menu(df: DataFrame, xml_col: str) -> DataFrame:
    """One row per ``menuItem/value`` of an XML menu."""
    menu = F.from_xml(F.col(xml_col), "menuItem array<struct<text string, value string>>")
    items = df.select("*", F.explode(menu["menuItem"]["value"]).alias("item"))
    return items.filter(F.col("item") != "")


ITEM_FIELDS = "title string, link string, description string, pubDate string, `dc:creator` string"
RSS_SCHEMA = f"item array<struct<{ITEM_FIELDS}>>"


def rss_articles(items: DataFrame, as_of: datetime, source: str = "rss", summary_chars: int | None = None) -> DataFrame:
    """Articles from feed items (title, link, description, pubDate, creator); ``summary_chars`` cuts the summary."""
    title, url = F.coalesce(_text(F.col("title")), F.lit("")), F.coalesce(_text(F.col("link")), F.lit(""))
    stamp = F.try_to_timestamp(F.substring("pubDate", 6, 20), F.lit("dd MMM yyyy HH:mm:ss"))
    summary = F.coalesce(F.trim(F.regexp_replace("description", "<[^>]+>", "")), F.lit(""))
    shaped = items.select(
        title.alias("title"), url.alias("url"),
        F.coalesce(stamp.cast("timestamp_ntz"), F.lit(as_of).cast("timestamp_ntz")).alias("published_date"),
        F.lit(source).alias("source"), _text(F.col("creator")).alias("author"),
        summary.alias("full_summary"),
    )
    kept = F.col("full_summary") if summary_chars is None else F.substring("full_summary", 1, summary_chars)
    return shaped.filter((F.col("title") != "") & (F.col("url") != "")).withColumn("summary", kept)


def read_rss(
    spark: SparkSession, path, as_of: datetime, cap: int | None = None, summary_chars: int | None = None
) -> DataFrame:
    """Articles of RSS files, without those lacking title or link.

    Items are read one by one, so a feed of any length is split. With ``cap`` only the first items of every
    feed count; then a whole feed is one row."""
    if cap is None:
        items = spark.read.format("xml").option("rowTag", "item").schema(ITEM_FIELDS).load(path)
    else:
        feeds = spark.read.format("xml").option("rowTag", "channel").schema(RSS_SCHEMA).load(path)
        items = feeds.select(F.explode(F.slice("item", 1, cap)).alias("i")).select("i.*")
    items = items.select("title", "link", "description", "pubDate", F.col("`dc:creator`").alias("creator"))
    return rss_articles(items, as_of, summary_chars=summary_chars)


# from a headline to the next one, or to the end of the page: the text around a headline has its dates and places
HEADLINE_BLOCK = r"(?s)<h3\b.*?</h3>.*?(?=<h3\b|\z)"


def extract_blocks(df: DataFrame, html: str, base: str, container: str = HEADLINE_BLOCK) -> DataFrame:
    """One row per block of a page that holds a link: link text, absolute URL and the block's text.

    A block is a headline and all that follows it up to the next one, or what ``container`` matches.
    Links with fewer than three characters of text are dropped."""
    keep = [c for c in df.columns if c != html]
    blocks = df.select(*keep, F.explode(F.regexp_extract_all(html, F.lit(container), F.lit(0))).alias("block"))
    link = r'(?s)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
    href = F.regexp_extract("block", link, 1)
    url = F.when(href.startswith("http"), href).when(href != "", F.concat(F.lit(base), href)).otherwise(F.lit(""))
    return blocks.select(
        *keep,
        squeeze(strip_tags(F.regexp_extract("block", link, 2))).alias("title"),
        url.alias("url"),
        squeeze(strip_tags(F.col("block"))).alias("block_text"),
    ).filter(F.length("title") >= 3)
