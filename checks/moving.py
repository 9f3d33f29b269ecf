"""S operators (sources), K operators (sinks and upserts) and the incremental feed.

Files are written below the shared folder, each run to a path of its own, and read back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from carlake import rules
from carlake.operators import upsert as U
from carlake.operators.merge_table import MergeTable
from carlake.operators.filters import select_available
from carlake.plans import news
from carlake.schemas import text_schema
from carlake.session import new_path
from carlake.sources import catalog, files, markup, series, sinks
from carlake.sources.archives import located
from carlake.streaming.feed import EVENTS, run_feed
from checks.registry import TABLES, query
from checks.tagging import NEWS_CATEGORY, NEWS_SENTIMENT, TAGGED_EVENTS

AS_OF = datetime(2026, 1, 1)
RAW = ["CMPLID", "MAKETXT", "MODELTXT", "YEARTXT", "CDESCR", "CITY"]


@query(
    "S01_read_csv",
    """SELECT CMPLID, MAKETXT, nullif(MODELTXT, '') AS MODELTXT, YEARTXT, nullif(CDESCR, '') AS CDESCR, CASE WHEN CAST(CMPLID AS BIGINT) % 2 = 0 THEN 'Montréal' ELSE 'Zürich' END
    AS CITY FROM {complaints_raw}""",
)
def _(t):
    path = new_path(t.spark, "csv")
    city = F.when(F.col("CMPLID").cast("long") % 2 == 0, "Montréal").otherwise("Zürich")
    df = t("complaints_raw").withColumn("CITY", city).select(*RAW)
    spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.options(header=True, escape='"', encoding="ISO-8859-1", **spaces).csv(path)
    return files.read_csv(t.spark, path, text_schema(RAW))


# a file as others write it: columns in another order and more of them, one missing, doubled quotes, line breaks in cells
FOREIGN = """SELECT CMPLID, MAKETXT, 'he said "' || MAKETXT || '", then' || chr(10) || 'left' AS CDESCR, CAST(NULL AS VARCHAR) AS CITY
    FROM {complaints_raw}"""


def foreign_file(t):
    path = new_path(t.spark, "csv")
    said = F.concat(F.lit('he said "'), "MAKETXT", F.lit('", then\nleft'))
    df = t("complaints_raw").select(said.alias("CDESCR"), F.lit("x").alias("OTHER"), "MAKETXT", "CMPLID")
    spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.options(header=True, escape='"', quoteAll=True, encoding="ISO-8859-1", **spaces).csv(path)
    return path


@query("S01_read_csv_by_name", FOREIGN)
def _(t):
    wanted = text_schema(["CMPLID", "MAKETXT", "CDESCR", "CITY"])
    return files.read_csv(t.spark, foreign_file(t), wanted, multi_line=True)


@query("P16_select_available_csv", "SELECT CMPLID, MAKETXT FROM {complaints_raw}")
def _(t):
    wanted = text_schema(["CMPLID", "MAKETXT", "CITY"])
    df = files.read_csv(t.spark, foreign_file(t), wanted, multi_line=True, only_present=True)
    return select_available(df, ["CMPLID", "CITY", "MAKETXT"])


@query(
    "S02_read_tsv",
    """SELECT CAST(l_orderkey AS VARCHAR) AS a, CAST(l_partkey AS VARCHAR) AS b, l_returnflag AS c,
    CASE WHEN l_orderkey % 50 = 1 THEN NULL ELSE l_linestatus END AS d FROM lineitem WHERE l_orderkey % 50 <> 0""",
)
def _(t):
    path = new_path(t.spark, "tsv")
    key = F.col("l_orderkey") % 50
    line = F.concat_ws(
        "\t", F.col("l_orderkey"), F.col("l_partkey"), F.col("l_returnflag"),
        F.when(key != 1, F.col("l_linestatus")), F.when(key == 0, F.lit("too much")),
    )
    t("lineitem").select(line.alias("value")).write.text(path)
    return files.read_tsv(t.spark, path, ["a", "b", "c", "d"])


def _zip(group):
    import io
    import zipfile

    import pandas as pd

    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("data.txt", "\r\n".join(group.sort_values("o_orderkey")["line"]))
        z.writestr("readme.pdf", "not wanted")
    return pd.DataFrame({"path": [str(group["part"].iloc[0])], "content": [packed.getvalue()]})


ZIPPED = """SELECT CAST((o_orderkey - o_orderkey % 500) / 500 AS BIGINT)::VARCHAR AS archive, 'data.txt' AS member,
    row_number() OVER (PARTITION BY o_orderkey - o_orderkey % 500 ORDER BY o_orderkey) - 1 AS line_no,
    o_orderkey || chr(9) || o_orderstatus AS line FROM orders"""


def _archives(t):
    """Archives of at most 500 lines each, packed from the orders: path and content."""
    lines = t("orders").select(
        "o_orderkey", F.expr("o_orderkey div 500").alias("part"),
        F.concat_ws("\t", F.col("o_orderkey"), F.col("o_orderstatus")).alias("line"),
    )
    return lines.groupBy("part").applyInPandas(_zip, "path string, content binary")


@query("S03_read_zip", ZIPPED)
def _(t):
    return files.unzip_lines(_archives(t))


@query("S03_read_archive_members", ZIPPED)
def _(t):
    folder = new_path(t.spark, "archives")

    def store(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                place, root = located(folder)
                place.create_dir(root)
                with place.open_output_stream(f"{root}/{name}.zip") as out:
                    out.write(content)
            yield batch[["path"]]

    _archives(t).mapInPandas(store, "path string").count()
    rows = files.read_archive_members(t.spark, folder)
    return rows.withColumn("archive", F.regexp_extract("archive", r"([^/]*)\.zip$", 1))


VEHICLE_SQL = """SELECT epa_id, year, nullif(trim(make), '') AS make,
    nullif(trim(regexp_replace(model, '<[^>]*>', '', 'g')), '') AS model, 'Unknown' AS vehicle_class, fuel_type1, fuel_type2,
    electric_range, coalesce(mpge_combined, '0') AS mpge_combined, 'Unknown' AS transmission, '' AS engine_descriptor,
    '0' AS annual_fuel_cost FROM {fuel_raw}"""
VEHICLE_COLUMNS = [
    "epa_id", "year", "make", "model", "vehicle_class", "fuel_type1", "fuel_type2", "electric_range", "mpge_combined",
    "transmission", "engine_descriptor", "annual_fuel_cost",
]


def vehicle_documents(t):
    """One XML document per fuel row; missing values are empty elements."""
    tags = {
        "id": "epa_id", "year": "year", "make": "make", "model": "model", "fuelType1": "fuel_type1",
        "fuelType2": "fuel_type2", "range": "electric_range", "comb08U": "mpge_combined",
    }
    df = t("fuel_raw").withColumn("model", F.regexp_replace("model", "<[^>]*>", ""))

    def element(tag, c):
        return F.concat(F.lit(f"<{tag}>"), F.coalesce(F.col(c), F.lit("")), F.lit(f"</{tag}>"))

    body = F.concat(*[element(tag, c) for tag, c in tags.items()])
    return df.select("epa_id", F.concat(F.lit("<vehicle>"), body, F.lit("<trany/></vehicle>")).alias("xml"))


@query("S04_read_vehicle_xml", VEHICLE_SQL)
def _(t):
    # files of a few hundred vehicles each, every file with one root element
    part = F.expr("cast(epa_id as bigint) div 300").alias("part")
    docs = vehicle_documents(t).groupBy(part).agg(
        F.concat(F.lit("<vehicles>"), F.array_join(F.collect_list("xml"), ""), F.lit("</vehicles>")).alias("value")
    )
    path = new_path(t.spark, "xml")
    docs.write.partitionBy("part").text(path)
    return markup.read_vehicle_xml(t.spark, path).select(*VEHICLE_COLUMNS)


@query("S04_parse_vehicle_xml", VEHICLE_SQL)
def _(t):
    return markup.parse_vehicle_xml(vehicle_documents(t), "xml").select(*VEHICLE_COLUMNS)


@query(
    "S04_vehicle_numbers",
    """SELECT epa_id, TRY_CAST(year AS DOUBLE) AS year, TRY_CAST(coalesce(electric_range, '0') AS DOUBLE) AS electric_range,
    TRY_CAST(coalesce(mpge_combined, '0') AS DOUBLE) AS mpge_combined, 0.0::DOUBLE AS annual_fuel_cost FROM {fuel_raw}""",
)
def _(t):
    df = markup.vehicle_numbers(markup.parse_vehicle_xml(vehicle_documents(t), "xml"))
    return df.select("epa_id", "year", "electric_range", "mpge_combined", "annual_fuel_cost")


@query(
    "S05_explode_menu",
    """SELECT p_partkey, p_name AS item FROM part UNION ALL SELECT p_partkey, p_brand FROM part WHERE p_partkey % 3 > 0""",
)
def _(t):
    def item(c):
        return F.concat(F.lit("<menuItem><text>x</text><value>"), c, F.lit("</value></menuItem>"))

    brand = F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")).otherwise("")
    xml = F.concat(F.lit("<menuItems>"), item(F.col("p_name")), item(brand), F.lit("</menuItems>"))
    return markup.explode_menu(t("part").select("p_partkey", xml.alias("xml")), "xml").drop("xml")


FEED_ITEMS = """SELECT title, url, published_date, author, summary FROM (
    SELECT CASE WHEN event_id % 11 = 0 THEN '' ELSE event_type || ' ' || event_id END AS title,
      'https://news.example/' || event_id AS url,
      CASE WHEN event_id % 7 = 0 THEN TIMESTAMP '2026-01-01 00:00:00' ELSE date_trunc('second', ts) END AS published_date,
      CASE WHEN event_id % 4 > 0 THEN 'User ' || user_id END AS author, 'A bold ' || event_type || ' story' AS summary,
      row_number() OVER (PARTITION BY event_id - event_id % 200 ORDER BY event_id) AS rn FROM events)
    WHERE {} AND title <> ''"""


def feed_files(t):
    # feeds of 200 items each
    title = F.when(F.col("event_id") % 11 == 0, "").otherwise(F.concat_ws(" ", "event_type", F.col("event_id").cast("string")))
    date = F.when(F.col("event_id") % 7 == 0, "yesterday").otherwise(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"))
    author = F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("User "), F.col("user_id").cast("string"))).otherwise("")
    item = F.concat(
        F.lit('<item><title>'), title, F.lit("</title><link>https://news.example/"), F.col("event_id").cast("string"),
        F.lit("</link><description>A &lt;b&gt;bold&lt;/b&gt; "), F.col("event_type"), F.lit(" story</description><pubDate>"),
        date, F.lit(" +0000</pubDate><dc:creator>"), author, F.lit("</dc:creator></item>"),
    )
    feeds = t("events").groupBy(F.expr("event_id div 200").alias("part")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", item.alias("x")))), lambda i: i["x"]), "").alias("items")
    )
    path = new_path(t.spark, "rss")
    opening = '<rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>feed</title>'
    documents = feeds.select("part", F.concat(F.lit(opening), "items", F.lit("</channel></rss>")).alias("value"))
    documents.write.partitionBy("part").text(path)
    return path


@query(
    "S06_read_rss",
    FEED_ITEMS.format("true"),
)
def _(t):
    return markup.read_rss(t.spark, feed_files(t), AS_OF).select("title", "url", "published_date", "author", "summary")


@query("S06_read_rss_first", FEED_ITEMS.format("rn <= 100"))
def _(t):
    first = markup.read_rss(t.spark, feed_files(t), AS_OF, cap=100, summary_chars=500)
    return first.select("title", "url", "published_date", "author", "summary")


LINK = '(?s)<a\\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>'


def squeezed(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({c}, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))"


@query(
    "S07_extract_blocks",
    f"""SELECT * FROM (SELECT page_id, {squeezed(f"regexp_extract(block, '{LINK}', 2)")} AS title,
      CASE WHEN starts_with(h, 'http') THEN h WHEN h <> '' THEN 'https://site.example' || h ELSE '' END AS url,
      {squeezed('block')} AS block_text
    FROM (SELECT *, regexp_extract(block, '{LINK}', 1) AS h FROM (
      SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li\\b.*?</li>', 0)) AS block FROM pages))) WHERE length(title) >= 3""",
)
def _(t):
    df = t("pages").select("page_id", "html")
    return markup.extract_blocks(df, "html", "https://site.example", r"(?s)<li\b.*?</li>")


# pages of trade events as they stand on a site: a headline with its link, then the text that has dates and places
PAGE_BLURBS = "(SELECT event_id, title, url, title || ' ' || block_text AS block_text FROM {blurbs})"


@query(
    "S07_blocks_to_events",
    TAGGED_EVENTS.replace("{blurbs}", PAGE_BLURBS),
)
def _(t):
    card = F.format_string(
        '<div class="event card">\n<h3 class="t"><a class="l" href="%s">%s</a></h3>\n<p>%s</p></div>', "url", "title", "block_text"
    )
    numbered = t("blurbs").select(F.expr("event_id div 100").alias("page"), F.struct("event_id", card.alias("card")).alias("c"))
    cards = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["card"]), "\n")
    pages = numbered.groupBy("page").agg(F.concat(F.lit("<html><body><h1>Events</h1>"), cards, F.lit("</body></html>")).alias("html"))
    blocks = markup.extract_blocks(pages, "html", "https://events.example").drop("page")
    df = news.tag_events(blocks, AS_OF, raw_chars=100, parts=t.parts)
    lists = ["key_topics", "participating_manufacturers"]
    return df.select(*[F.array_join(c, "|").alias(c) if c in lists else F.col(c) for c in df.columns])


EVENT_JSON = """event_id bigint, title string, date_start date, date_end date, location string,
    participating_manufacturers array<string>, relevance_score double"""


@query(
    "S08_read_json",
    """SELECT event_id, title, date_start, date_end, location, array_to_string(participating_manufacturers, '|') AS makers,
    relevance_score FROM {trade_events}""",
)
def _(t):
    path = new_path(t.spark, "json")
    sinks.write_json(t("trade_events"), path)
    df = files.read_json(t.spark, path, EVENT_JSON, multi_line=False)
    return df.withColumn("makers", F.array_join("participating_manufacturers", "|")).drop("participating_manufacturers")


@query(
    "S09_parse_observations",
    """SELECT strftime(ts, '%Y-%m-%d') AS date, value, event_type AS series_id FROM events
    UNION ALL SELECT '2020-01-01', 7.5, event_type FROM events WHERE event_id % 2 = 0""",
)
def _(t):
    second = F.when(F.col("event_id") % 2 == 0, "7.5").otherwise(".")
    payload = F.to_json(
        F.struct(
            F.array(
                F.struct(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("value").cast("string").alias("value")),
                F.struct(F.lit("2020-01-01").alias("date"), second.alias("value")),
            ).alias("observations")
        )
    )
    return series.parse_observations(t("events").select(payload.alias("payload"), "event_type"), "payload", "event_type")


@query(
    "S10_catalog_profile",
    """SELECT v.*, CASE table_name WHEN 'region' THEN (SELECT count(*) FROM region) WHEN 'part' THEN (SELECT count(*) FROM part)
    ELSE (SELECT count(*) FROM events) END AS row_count FROM (VALUES
    ('region', 1, 'r_regionkey', 'int', true), ('region', 2, 'r_name', 'string', true),
    ('part', 1, 'p_partkey', 'bigint', true), ('part', 2, 'p_name', 'string', true), ('part', 3, 'p_brand', 'string', true),
    ('part', 4, 'p_type', 'string', true), ('part', 5, 'p_size', 'int', true), ('part', 6, 'p_retailprice', 'double', true),
    ('events', 1, 'event_id', 'bigint', true), ('events', 2, 'ts', TS, true),
    ('events', 3, 'user_id', 'bigint', true), ('events', 4, 'event_type', 'string', true), ('events', 5, 'value', 'double', true),
    ('events', 6, 'props', 'string', true)) v(table_name, position, column_name, data_type, nullable)""".replace("TS", "'timestamp_ntz'"),
)
def _(t):
    return catalog.catalog_profile({n: t(n) for n in ("region", "part", "events")})


# readers that keep what they cannot read: both parts of a table come back, kept rows and rejected lines


def both_parts(t, df):
    kept, rejected, counts = sinks.write_split(df, new_path(t.spark, "checked"))
    sizes = [F.lit(counts[k]).cast("long").alias(f"n_{k}") for k in ("kept", "rejected")]
    return kept.unionByName(rejected, allowMissingColumns=True).select("*", *sizes)


COUNTED = """, (SELECT count(*) FROM {0} WHERE NOT ({1})) AS n_kept, (SELECT count(*) FROM {0} WHERE {1}) AS n_rejected"""


@query(
    "S02_read_tsv_checked",
    f"""SELECT CASE WHEN l_orderkey % 50 <> 0 THEN CAST(l_orderkey AS VARCHAR) END AS a,
    CASE WHEN l_orderkey % 50 <> 0 THEN CAST(l_partkey AS VARCHAR) END AS b, CASE WHEN l_orderkey % 50 <> 0 THEN l_returnflag END AS c,
    CASE WHEN l_orderkey % 50 > 1 THEN l_linestatus END AS d,
    CASE WHEN l_orderkey % 50 = 0 THEN l_orderkey || chr(9) || l_partkey || chr(9) || l_returnflag || chr(9) || l_linestatus || chr(9) || 'too much'
      || CASE WHEN l_linenumber > 2 THEN chr(9) || 'by far' ELSE '' END END AS rejected_line
    {COUNTED.format("lineitem", "l_orderkey % 50 = 0")} FROM lineitem""",
)
def _(t):
    path = new_path(t.spark, "tsv")
    key = F.col("l_orderkey") % 50
    more = F.when(F.col("l_linenumber") > 2, F.lit("too much\tby far")).otherwise(F.lit("too much"))
    line = F.concat_ws(
        "\t", F.col("l_orderkey"), F.col("l_partkey"), F.col("l_returnflag"), F.when(key != 1, F.col("l_linestatus")), F.when(key == 0, more)
    )
    t("lineitem").select(line.alias("value")).write.text(path)
    return both_parts(t, files.read_tsv_checked(t.spark, path, ["a", "b", "c", "d"]))


@query(
    "S01_read_csv_checked",
    f"""SELECT CASE WHEN o_orderkey % 9 > 1 THEN o_orderkey END AS id, CASE WHEN o_orderkey % 9 > 1 THEN o_orderpriority END AS what,
    CASE o_orderkey % 9 WHEN 0 THEN o_orderkey || ',' || o_orderpriority || ',more' WHEN 1 THEN 'no' || o_orderkey || ',' || o_orderpriority END AS rejected_line
    {COUNTED.format("orders", "o_orderkey % 9 < 2")} FROM orders""",
)
def _(t):
    path = new_path(t.spark, "csv")
    part = F.col("o_orderkey") % 9
    number = F.when(part == 1, F.concat(F.lit("no"), "o_orderkey")).otherwise(F.col("o_orderkey").cast("string"))
    line = F.concat_ws(",", number, "o_orderpriority", F.when(part == 0, F.lit("more")))
    swapped = F.concat_ws(",", "o_orderpriority", number)
    # two kinds of files: the columns the other way round go to a folder of their own; a tab never occurs, so nothing is quoted
    t("orders").where(part >= 2).select(swapped.alias("what,id")).write.options(header=True, sep="\t").csv(f"{path}/swapped")
    t("orders").where(part < 2).select(line.alias("id,what")).write.options(header=True, sep="\t").csv(f"{path}/plain")
    parts = [files.read_csv_checked(t.spark, f"{path}/{kind}", "id long, what string") for kind in ("swapped", "plain")]
    return both_parts(t, parts[0].unionByName(parts[1]))


@query(
    "S08_read_json_checked",
    f"""SELECT CASE WHEN c_custkey % 7 > 1 THEN c_custkey END AS id, CASE WHEN c_custkey % 7 > 1 THEN c_name END AS name,
    CASE c_custkey % 7 WHEN 0 THEN '{{{{"id": ' || c_custkey || ', "name": ' WHEN 1 THEN '{{{{"id": "x' || c_custkey || '", "name": "n"}}}}' END AS rejected_line
    {COUNTED.format("customer", "c_custkey % 7 < 2")} FROM customer""".replace("{{", "{").replace("}}", "}"),
)
def _(t):
    path = new_path(t.spark, "json")
    part = F.col("c_custkey") % 7
    key = F.col("c_custkey").cast("string")
    line = (
        F.when(part == 0, F.concat(F.lit('{"id": '), key, F.lit(', "name": ')))
        .when(part == 1, F.concat(F.lit('{"id": "x'), key, F.lit('", "name": "n"}')))
        .otherwise(F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))))
    )
    t("customer").select(line.alias("value")).write.text(path)
    return both_parts(t, files.read_json_checked(t.spark, path, "id long, name string"))


@query(
    "S10_catalog_of_files",
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, (SELECT count(*) FROM {n}) AS row_count, "
                       f"(SELECT count(*) FROM duckdb_columns() WHERE table_name = '{n}') AS n_columns" for n in TABLES),
)
def _(t):
    rows = catalog.catalog_of_files(t.spark, {n: f"{t.folder}/{n}.parquet" for n in TABLES})
    return rows.groupBy("table_name", "row_count").agg(F.count("*").alias("n_columns"))


# --- sinks --------------------------------------------------------------------------------


@query("K01_write_parquet", "SELECT o_orderkey, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def _(t):
    path = new_path(t.spark, "parquet")
    df = t("orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    # a few files a year and no task that gets a whole year
    dealt = df.repartition(t.parts, "year", F.pmod(F.xxhash64("o_orderkey"), F.lit(t.parts)))
    sinks.write_parquet(dealt, path, ["year"])
    return t.spark.read.parquet(path)


@query(
    "K02_write_csv",
    """SELECT event_id, title, date_start, '["' || array_to_string(participating_manufacturers, '","') || '"]'
    AS participating_manufacturers FROM {trade_events}""",
)
def _(t):
    path = new_path(t.spark, "csv")
    df = t("trade_events").select("event_id", "title", "date_start", "participating_manufacturers")
    sinks.write_csv(df, path)
    ddl = "event_id bigint, title string, date_start date, participating_manufacturers string"
    return files.read_csv(t.spark, path, ddl)


@query("K03_safe_overwrite", "SELECT * FROM orders")
def _(t):
    path = new_path(t.spark, "lake") + "/cleaned/orders"
    sinks.safe_overwrite(t("orders").limit(1), path)
    sinks.safe_overwrite(t("orders"), path)
    return t.spark.read.parquet(path)


@query("K04_write_json", "SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer")
def _(t):
    path = new_path(t.spark, "json")
    balance = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    sinks.write_json(t("customer").select("c_custkey", "c_name", balance.alias("c_acctbal")), path)
    return t.spark.read.schema("c_custkey bigint, c_name string, c_acctbal double").json(path)


@query("K05_load_table", "SELECT *, (SELECT count(*) FROM customer) AS loaded, (SELECT count(*) FROM customer) AS verified FROM customer")
def _(t):
    path = new_path(t.spark, "table")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    counts = sinks.load_table(t("customer"), name, path)
    table = t.spark.table(name)
    return table.select("*", F.lit(counts["loaded"]).cast("long").alias("loaded"), F.lit(counts["verified"]).cast("long").alias("verified"))


UPSERT = """WITH old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY article_id) AS r FROM {articles_raw}
    WHERE published_date < TIMESTAMP '2024-01-16') WHERE r = 1),
  new AS (SELECT * FROM {articles_raw} WHERE published_date >= TIMESTAMP '2024-01-14'),
  last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY article_id DESC) AS r FROM new) WHERE r = 1),
  first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY article_id) AS r FROM new) WHERE r = 1)
SELECT url, coalesce(l.title, o.title) AS title, coalesce(l.summary, o.summary) AS summary,
  coalesce(l.published_date, o.published_date) AS published_date,
  CASE WHEN o.url IS NULL THEN f.source ELSE o.source END AS source,
  CASE WHEN o.url IS NULL THEN f.author ELSE o.author END AS author
FROM old o FULL JOIN last l USING (url) LEFT JOIN first f USING (url)"""


def _articles(t):
    """A table of early articles, one a url, and a batch of later ones."""
    df = t("articles_raw").select("article_id", "url", "title", "summary", "published_date", "source", "author")
    day = F.col("published_date")
    old = df.filter(day < F.lit(datetime(2024, 1, 16)))
    old = old.groupBy("url").agg(F.min_by(F.struct("title", "summary", "published_date", "source", "author"), "article_id").alias("r"))
    return old.select("url", "r.*"), df.filter(day >= F.lit(datetime(2024, 1, 14)))


@query("K06_upsert_articles", UPSERT)
def _(t):
    return U.upsert_articles(*_articles(t), "article_id")


def _merged(t, name, old, batches, key, keys, frozen=(), null_safe=False):
    """The rows of a bucketed table after its first load and the batches."""
    table = MergeTable(new_path(t.spark, name), old.schema, keys, frozen, null_safe, buckets=16)
    table.merge(old.withColumn("_first_load", F.lit(0)), "_first_load")
    for batch in batches:
        table.merge(batch, key)
    return table.read(t.spark)


@query("K06_merge_table", UPSERT)
def _(t):
    # the batch comes in two parts, the second one by the end of the article's number
    old, new = _articles(t)
    middle = new.agg(F.avg("article_id")).scalar()
    batches = [new.filter(F.col("article_id") < middle), new.filter(F.col("article_id") >= middle)]
    return _merged(t, "articles", old, batches, "article_id", ["url"], U.ARTICLE_FROZEN)


EVENT_UPSERT = """WITH ev AS (SELECT event_id, title, CASE WHEN event_id % 7 > 0 THEN date_start END AS date_start, location, relevance_score
      FROM {trade_events}),
  old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title, date_start ORDER BY event_id) AS r FROM ev
    WHERE event_id < (SELECT avg(o_orderkey) FROM orders)) WHERE r = 1),
  last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title, date_start ORDER BY event_id DESC) AS r FROM ev
    WHERE event_id >= (SELECT avg(o_orderkey) FROM orders)) WHERE r = 1)
SELECT coalesce(l.title, o.title) AS title, coalesce(l.date_start, o.date_start) AS date_start,
  CASE WHEN l.title IS NULL THEN o.location ELSE l.location END AS location,
  CASE WHEN l.title IS NULL THEN o.relevance_score ELSE l.relevance_score END AS relevance_score
FROM old o FULL JOIN last l ON o.title = l.title AND o.date_start IS NOT DISTINCT FROM l.date_start"""


def _events(t):
    df = t("trade_events").select(
        "event_id", "title", F.when(F.col("event_id") % 7 > 0, F.col("date_start")).alias("date_start"), "location",
        "relevance_score",
    )
    middle = t("orders").agg(F.avg("o_orderkey")).scalar()
    old = df.filter(F.col("event_id") < middle).groupBy("title", "date_start").agg(
        F.min_by(F.struct("location", "relevance_score"), "event_id").alias("r")
    )
    return old.select("title", "date_start", "r.*"), df.filter(F.col("event_id") >= middle)


@query("K07_upsert_events", EVENT_UPSERT)
def _(t):
    return U.upsert_events(*_events(t), "event_id")


@query("K07_merge_table", EVENT_UPSERT)
def _(t):
    old, new = _events(t)
    return _merged(t, "events", old, [new], "event_id", ["title", "date_start"], null_safe=True)


@query(
    "J05_match_keys",
    """WITH ev AS (SELECT event_id, title, CASE WHEN event_id % 7 > 0 THEN date_start END AS date_start FROM {trade_events}),
  old AS (SELECT DISTINCT title, date_start FROM ev WHERE event_id < (SELECT avg(o_orderkey) FROM orders)),
  new AS (SELECT title, date_start, count(*) AS n FROM ev WHERE event_id >= (SELECT avg(o_orderkey) FROM orders) GROUP BY ALL)
SELECT coalesce(old.title, new.title) AS title, coalesce(old.date_start, new.date_start) AS date_start, coalesce(n, 0) AS n_updates,
  CASE WHEN new.title IS NULL THEN 'keep' WHEN old.title IS NULL THEN 'insert' ELSE 'update' END AS outcome
FROM old FULL JOIN new ON old.title = new.title AND old.date_start IS NOT DISTINCT FROM new.date_start""",
)
def _(t):
    return U.match_keys(*_events(t), ["title", "date_start"], null_safe=True)


@query(
    "K08_append_audit",
    """SELECT event_id AS audit_id, user_id, 'FACT_RECALLS,' || event_type AS tables_accessed FROM events
    UNION ALL SELECT event_id + 1000000, user_id, 'FACT_RATINGS' FROM events""",
)
def _(t):
    path = new_path(t.spark, "audit")
    first = t("events").select(
        F.col("event_id").alias("audit_id"), "user_id", F.array(F.lit("FACT_RECALLS"), "event_type").alias("tables_accessed")
    )
    second = t("events").select(
        (F.col("event_id") + 1000000).alias("audit_id"), "user_id", F.array(F.lit("FACT_RATINGS")).alias("tables_accessed")
    )
    sinks.append_audit(first, path)
    sinks.append_audit(second, path)
    return t.spark.read.parquet(path)


@query("K09_export_result", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / 7, 3) AS price FROM lineitem")
def _(t):
    path = new_path(t.spark, "export")
    sinks.export_result(t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 7).alias("price")), path)
    return files.read_csv(t.spark, path, "l_orderkey bigint, l_linenumber int, price double")


# --- incremental feed ---------------------------------------------------------------------

FEED = f"""WITH a AS (SELECT *, lower(title || ' ' || summary) AS low FROM {{articles_raw}}),
  ranked AS (SELECT *, {NEWS_CATEGORY} AS category, {NEWS_SENTIMENT} AS sentiment,
    row_number() OVER (PARTITION BY url ORDER BY article_id DESC) AS back, row_number() OVER (PARTITION BY url ORDER BY article_id)
    AS ahead FROM a)
SELECT l.url, l.title, l.summary, l.published_date, f.source, f.author, l.category, l.sentiment
FROM ranked l JOIN ranked f USING (url) WHERE l.back = 1 AND f.ahead = 1"""


@query("I01_run_feed", FEED)
def _(t):
    # the articles arrive in three deliveries; a url occurs once in each, so later ones update earlier ones
    root = new_path(t.spark, "feed")
    df = t("articles_raw").select("article_id", "title", "url", "published_date", "source", "author", "summary")
    for delivery in range(3):
        part = df.filter(F.col("article_id") % 3 == delivery).drop("article_id")
        part.write.mode("append").options(**sinks.TIME_FORMATS).json(f"{root}/landing")
        run_feed(t.spark, f"{root}/landing", f"{root}/articles", f"{root}/checkpoint", AS_OF)
    table = U.read_snapshot(t.spark, f"{root}/articles")
    return table.select("url", "title", "summary", "published_date", "source", "author", "category", "sentiment")


@query("I01_run_feed_events", f"SELECT DISTINCT title, date_start FROM ({TAGGED_EVENTS})")
def _(t):
    # three deliveries; of several blurbs with one title and start date one row stays
    root = new_path(t.spark, "event_feed")
    for delivery in range(3):
        part = t("blurbs").filter(F.col("event_id") % 3 == delivery).select("title", "url", "block_text")
        part.write.mode("append").json(f"{root}/landing")
        run_feed(t.spark, f"{root}/landing", f"{root}/events", f"{root}/checkpoint", AS_OF, kind=EVENTS)
    return U.read_snapshot(t.spark, f"{root}/events").select("title", "date_start")


@query("I01_run_feed_repeats", FEED)
def _(t):
    # every delivery brings the one before it again; a state store drops those rows before they are tagged
    root = new_path(t.spark, "feed")
    df = t("articles_raw").select("article_id", "title", "url", "published_date", "source", "author", "summary")
    for delivery in range(3):
        for part in range(max(0, delivery - 1), delivery + 1):
            rows = df.filter(F.col("article_id") % 3 == part).drop("article_id")
            rows.write.mode("append").options(**sinks.TIME_FORMATS).json(f"{root}/landing")
        run_feed(t.spark, f"{root}/landing", f"{root}/articles", f"{root}/checkpoint", AS_OF, remember_days=7)
    table = U.read_snapshot(t.spark, f"{root}/articles")
    return table.select("url", "title", "summary", "published_date", "source", "author", "category", "sentiment")
