"""A operators (aggregation), L operators (order and limit) and J operators (joins)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carlake.functions import derived as D
from carlake.operators import aggregates as A
from carlake.operators import joins as J
from carlake.sources.catalog import catalog_profile
from checks.registry import query

NEWS_AS_OF = datetime(2024, 1, 31)
MAKERS = ["Ford", "Tesla", "Kia", "Jeep", "Honda"]


@query("A01_distribution", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    return A.distribution(t("events"), "event_type")


@query("A02_count_by_year", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return A.count_by_year(t("orders").select(F.year("o_orderdate").alias("year")))


@query(
    "A03_quality_stats",
    """SELECT count(*) FILTER (crash_flag) AS crashes, count(*) FILTER (severity_level = 'CRITICAL') AS critical,
    count(*) FILTER (year < 2020) AS old FROM {complaint_facts}""",
)
def _(t):
    return A.quality_stats(
        t("complaint_facts"), crashes=F.col("crash_flag"), critical=F.col("severity_level") == "CRITICAL",
        old=F.col("year") < 2020,
    )


@query(
    "A04_run_summary",
    """SELECT a AS initial_rows, b AS final_rows, a - b AS removed_rows, round(b * 100.0 / a, 1) AS retention_pct
    FROM (SELECT count(*) AS a, count(DISTINCT (l_orderkey, l_linenumber)) AS b FROM lineitem)""",
)
def _(t):
    lines = t("lineitem").select("l_orderkey", "l_linenumber")
    return A.run_summary(lines, lines.distinct())


@query(
    "A04_summarize_step",
    """SELECT a AS initial_rows, b AS final_rows, a - b AS removed_rows, round(b * 100.0 / a, 1) AS retention_pct
    FROM (SELECT count(*) AS a, count(DISTINCT (l_orderkey, l_linenumber)) AS b FROM lineitem)""",
)
def _(t):
    return A.summarize_step(t("lineitem").select("l_orderkey", "l_linenumber"), DataFrame.distinct)


@query(
    "A05_describe",
    """SELECT count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev(o_totalprice), 4) AS stddev,
    min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders""",
)
def _(t):
    d = A.describe(t("orders"), "o_totalprice")
    return d.select("n", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"), "min", "max")


@query("A06_date_range", "SELECT min(ts) AS first_date, max(ts) AS last_date FROM events")
def _(t):
    return A.date_range(t("events"), "ts")


@query(
    "A07_avg_by",
    """SELECT o_orderpriority, round(avg(o_totalprice), 3) AS mean, count(o_totalprice) AS n FROM orders
    WHERE o_totalprice > 100000 GROUP BY 1""",
)
def _(t):
    return A.avg_by(t("orders"), "o_orderpriority", "o_totalprice", F.col("o_totalprice") > 100000, 3)


@query(
    "A08_share",
    "SELECT l_suppkey, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM lineitem GROUP BY 1",
)
def _(t):
    return A.share(t("lineitem"), "l_suppkey").withColumn("pct", F.round("pct", 6))


@query(
    "A09_n_distinct",
    """SELECT count(DISTINCT l_partkey) AS l_partkey_distinct, count(DISTINCT l_suppkey) AS l_suppkey_distinct,
    count(DISTINCT l_returnflag) AS l_returnflag_distinct FROM lineitem""",
)
def _(t):
    return A.n_distinct(t("lineitem"), "l_partkey", "l_suppkey", "l_returnflag")


@query(
    "A10_avg_by_year",
    "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, round(avg(o_totalprice), 4) AS mean, count(*) AS n FROM orders GROUP BY 1",
)
def _(t):
    return A.avg_by_year(t("orders"), "o_orderdate", "o_totalprice").withColumn("mean", F.round("mean", 4))


NAMES = "(VALUES ('Ford'), ('Tesla'), ('Kia'), ('Jeep'), ('Honda')) m(maker)"
HITS = f"""(SELECT maker, a.* FROM {{articles}} a JOIN {NAMES} ON contains(lower(title), lower(maker))
    OR contains(lower(summary), lower(maker)) WHERE published_date >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY)"""


@query(
    "A11_sentiment_mix",
    f"""SELECT maker, sentiment, count(*) AS n, round(avg(importance_score), 6) AS avg_importance,
    CAST(sum(count(*)) OVER (PARTITION BY maker) AS BIGINT) AS total_articles FROM {HITS} GROUP BY maker, sentiment""",
)
def _(t):
    mix = A.sentiment_mix(t("articles"), MAKERS, 14, NEWS_AS_OF)
    return mix.withColumn("avg_importance", F.round("avg_importance", 6))


@query(
    "A12_compare_makers",
    f"""WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY maker ORDER BY published_date DESC, article_id) AS r
      FROM {HITS})
    SELECT maker, count(*) AS total_mentions, count(*) FILTER (lower(sentiment) = 'positive') AS positive,
      count(*) FILTER (lower(sentiment) = 'neutral') AS neutral, count(*) FILTER (lower(sentiment) = 'negative') AS negative,
      round(coalesce(avg(nullif(importance_score, 0)), 0), 6) AS avg_importance,
      string_agg(title, '|' ORDER BY r) FILTER (r <= 5) AS recent_titles
    FROM ranked GROUP BY maker""",
)
def _(t):
    report = A.compare_makers(t("articles"), MAKERS, 14, NEWS_AS_OF)
    return report.withColumn("avg_importance", F.round("avg_importance", 6)).withColumn(
        "recent_titles", F.array_join("recent_titles", "|")
    )


@query(
    "A12_compare_newest",
    f"""WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY maker ORDER BY published_date DESC, article_id) AS r
      FROM {HITS})
    SELECT maker, count(*) AS total_mentions, count(*) FILTER (lower(sentiment) = 'positive') AS positive,
      string_agg(title, '|' ORDER BY r) FILTER (r <= 2) AS recent_titles
    FROM ranked WHERE r <= 50 GROUP BY maker""",
)
def _(t):
    report = A.compare_makers(t("articles"), MAKERS, 14, NEWS_AS_OF, cap=50, newest=2)
    return report.select("maker", "total_mentions", "positive", F.array_join("recent_titles", "|").alias("recent_titles"))


@query(
    "A13_top_mentions",
    """SELECT mention, count(*) AS n FROM (SELECT unnest(participating_manufacturers) AS mention FROM {trade_events})
    GROUP BY 1 ORDER BY n DESC, mention LIMIT 3""",
)
def _(t):
    return A.top_mentions(t("trade_events"), "participating_manufacturers", 3)


@query(
    "A14_status_counts",
    """SELECT requester_username, count(*) AS total, count(*) FILTER (status = 'pending') AS pending,
    count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'rejected') AS rejected
    FROM {requests} GROUP BY 1""",
)
def _(t):
    return A.status_counts(t("requests"), "requester_username")


@query("A15_having", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 30")
def _(t):
    return A.having(t("lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")), F.col("n") > 30)


@query("L01_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(t):
    df = t("orders").select("o_orderkey", "o_totalprice")
    return A.top_n(df, [F.desc("o_totalprice"), F.asc("o_orderkey")], 25)


@query(
    "L02_n_largest",
    """SELECT fuel_economy_id, make, electric_range FROM {fuel_facts} WHERE is_electric
    ORDER BY electric_range DESC, fuel_economy_id LIMIT 5""",
)
def _(t):
    df = t("fuel_facts").filter("is_electric").select("fuel_economy_id", "make", "electric_range")
    return A.n_largest(df, "electric_range", 5, ties=["fuel_economy_id"])


@query("L03_order_nulls_last", "SELECT event_id, date_end FROM {trade_events}")
def _(t):
    return A.order_nulls_last(t("trade_events").select("event_id", "date_end"), "date_end", "event_id")


@query(
    "L04_capped",
    """SELECT o_orderkey, o_totalprice, (SELECT count(*) > 100 FROM orders) AS truncated FROM orders
    ORDER BY o_totalprice, o_orderkey LIMIT 100""",
)
def _(t):
    df = t("orders").select("o_orderkey", "o_totalprice")
    return A.capped(df, [F.asc("o_totalprice"), F.asc("o_orderkey")], 100)


@query(
    "L05_top_k_per",
    """SELECT c_mktsegment, c_custkey, c_acctbal, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (
    PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3""",
)
def _(t):
    df = t("customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    return A.top_k_per(df, ["c_mktsegment"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3)


# --- joins --------------------------------------------------------------------------------

SCORECARD = """
WITH r AS (SELECT make, count(DISTINCT recall_id) AS recall_count FROM {recall_facts} WHERE year BETWEEN 2015 AND 2025
    GROUP BY make),
  s AS (SELECT upper(make) AS k, avg(overall_stars) AS avg_rating FROM {rating_facts} GROUP BY 1),
  c AS (SELECT upper(make) AS k, avg(sentiment_score) AS avg_sentiment, count(DISTINCT complaint_id) AS complaint_count
    FROM {complaint_facts} GROUP BY 1)
SELECT make, recall_count, round(avg_rating, 6) AS avg_rating, round(avg_sentiment, 6) AS avg_sentiment,
  coalesce(complaint_count, 0) AS complaint_count
FROM r LEFT JOIN s ON upper(r.make) = s.k LEFT JOIN c ON upper(r.make) = c.k ORDER BY recall_count DESC, make LIMIT 20"""


def scorecard(t):
    df = J.make_scorecard(t("recall_facts"), t("rating_facts"), t("complaint_facts"))
    return df.withColumn("avg_rating", F.round("avg_rating", 6)).withColumn("avg_sentiment", F.round("avg_sentiment", 6))


@query("J01_make_scorecard", SCORECARD)
def _(t):
    return scorecard(t)


@query(
    "J02_inner_count",
    """SELECT a.make, count(*) AS n FROM {recall_facts} a JOIN {investigation_facts} b ON a.make = b.make GROUP BY 1""",
)
def _(t):
    return J.inner_count(t("recall_facts"), t("investigation_facts"), "make")


VEHICLE_JOIN = """SELECT c.complaint_id, c.make, s.rating_id, s.overall_stars FROM {complaint_facts} c
    JOIN {rating_facts} s ON c.vehicle_id = s.vehicle_id"""


def joined(t, salts):
    left = t("complaint_facts").select("vehicle_id", "complaint_id", "make")
    right = t("rating_facts").select("vehicle_id", "rating_id", "overall_stars")
    return J.join_vehicle(left, right, salts=salts).drop("vehicle_id")


@query("J03_join_vehicle", VEHICLE_JOIN)
def _(t):
    return joined(t, 1)


@query("J03_join_vehicle_salted", VEHICLE_JOIN)
def _(t):
    return joined(t, 8)


@query(
    "J03_join_make_year",
    """SELECT a.make, a.year, a.n AS recalls, b.n AS complaints FROM
    (SELECT make, year, count(*) AS n FROM {recall_facts} GROUP BY ALL) a
    LEFT JOIN (SELECT make, year, count(*) AS n FROM {complaint_facts} GROUP BY ALL) b
    ON a.make = b.make AND a.year = b.year""",
)
def _(t):
    recalls = t("recall_facts").groupBy("make", "year").agg(F.count("*").alias("recalls"))
    complaints = t("complaint_facts").groupBy("make", "year").agg(F.count("*").alias("complaints"))
    return J.join_vehicle(recalls, complaints, ["make", "year"], "left")


KNOWN = "(VALUES ('NHTSA', 'FACT_RECALLS'), ('NHTSA', 'FACT_COMPLAINTS'), ('EPA', 'FACT_FUEL_ECONOMY')) k(s, n)"


@query(
    "J06_unknown_refs",
    f"""SELECT audit_id, table_ref FROM (
      SELECT audit_id, unnest(['FACT_RECALLS', 'NHTSA.FACT_COMPLAINTS', 'EPA.FACT_RECALLS', 'T' || (user_id % 5)]) AS table_ref
      FROM {{sql_log}}) x
    WHERE NOT EXISTS (SELECT 1 FROM {KNOWN} WHERE x.table_ref IN (n, s || '.' || n))""",
)
def _(t):
    refs = t("sql_log").select(
        "audit_id",
        F.explode(
            F.array(
                F.lit("FACT_RECALLS"), F.lit("NHTSA.FACT_COMPLAINTS"), F.lit("EPA.FACT_RECALLS"),
                F.concat(F.lit("T"), (F.col("user_id") % 5).cast("string")),
            )
        ).alias("table_ref"),
    )
    catalog = t.spark.createDataFrame(
        [("NHTSA", "FACT_RECALLS"), ("NHTSA", "FACT_COMPLAINTS"), ("EPA", "FACT_FUEL_ECONOMY")],
        "schema_name string, table_name string",
    )
    return J.unknown_refs(refs, catalog)


@query(
    "J07_apply_thresholds",
    """SELECT approval_id, user_tier,
    CASE user_tier WHEN 'manager' THEN 20.0 WHEN 'executive' THEN 'inf' ELSE 5.0 END::DOUBLE AS max_cost,
    CASE user_tier WHEN 'manager' THEN 1000000 WHEN 'executive' THEN 'inf' ELSE 500000 END::DOUBLE AS max_rows,
    CASE user_tier WHEN 'manager' THEN 5 WHEN 'executive' THEN 'inf' ELSE 3 END::DOUBLE AS max_tables FROM {requests}"""
    .replace("'inf'", "CAST('inf' AS DOUBLE)"),
)
def _(t):
    return J.apply_thresholds(t("requests").select("approval_id", "user_tier"), "user_tier")


@query(
    "J04_metadata_join",
    "SELECT c.*, t.row_count FROM (VALUES "
    + ", ".join(
        f"('{s}', '{n}', '{c}', {i})"
        for s, n, columns in [
            ("sales", "customer", "c_custkey c_name c_nationkey c_acctbal c_mktsegment"),
            ("web", "documents", "doc_id text lang source n_chars"),
            ("web", "pages", "page_id url html"),
            ("web", "labels", "doc_id quality toxic"),
        ]
        for i, c in enumerate(columns.split(), 1)
    )
    + """) c(schema_name, table_name, column_name, position) JOIN (
    SELECT 'sales' AS schema_name, 'customer' AS table_name, count(*) AS row_count FROM customer UNION ALL
    SELECT 'web', 'documents', count(*) FROM documents UNION ALL SELECT 'web', 'pages', count(*) FROM pages UNION ALL
    SELECT 'web', 'labels', count(*) FROM labels) t USING (schema_name, table_name)""",
)
def _(t):
    schemas = {"customer": "sales", "documents": "web", "pages": "web", "labels": "web"}
    profile = catalog_profile({n: t(n) for n in schemas})
    schema = F.coalesce(*[F.when(F.col("table_name") == n, s) for n, s in schemas.items()]).alias("schema_name")
    columns = profile.select(schema, "table_name", "column_name", "position")
    tables = profile.select(schema, "table_name", "row_count").distinct()
    return J.metadata_join(tables, columns)
