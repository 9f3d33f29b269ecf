"""N queries: the documented analytic questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from carlake.plans import catalogue as N
from checks.aggregating import SCORECARD
from checks.registry import query


def r6(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query(
    "N01_open_investigations",
    "SELECT make, count(*) AS open_count FROM {investigation_facts} WHERE investigation_status = 'OPEN' GROUP BY 1",
)
def _(t):
    return N.open_investigations(t("investigation_facts"))


@query(
    "N02_recalled_components",
    "SELECT component_name, count(*) AS recall_count FROM {investigation_facts} WHERE has_recall GROUP BY 1",
)
def _(t):
    return N.recalled_components(t("investigation_facts"))


@query(
    "N03_investigations_per_year",
    "SELECT CAST(year(open_date) AS INTEGER) AS year, count(*) AS n FROM {investigation_facts} GROUP BY 1",
)
def _(t):
    return N.investigations_per_year(t("investigation_facts"))


@query("N04_mean_stars_per_make", "SELECT make, round(avg(overall_stars), 6) AS avg_stars FROM {rating_facts} GROUP BY 1")
def _(t):
    return r6(N.mean_stars(t("rating_facts"), "make"), "avg_stars")


@query("N04_mean_stars_per_year", "SELECT year, round(avg(overall_stars), 6) AS avg_stars FROM {rating_facts} GROUP BY 1")
def _(t):
    return r6(N.mean_stars(t("rating_facts"), "year"), "avg_stars")


@query("N05_safest_vehicles", "SELECT * FROM {rating_facts} WHERE overall_stars >= 5 AND has_advanced_safety")
def _(t):
    return N.safest_vehicles(t("rating_facts"))


@query("N06_crashes_per_make", "SELECT make, count(*) AS crash_count FROM {complaint_facts} WHERE crash_flag GROUP BY 1")
def _(t):
    return N.crashes_per_make(t("complaint_facts"))


@query("N07_severity_distribution", "SELECT severity_level, count(*) AS n FROM {complaint_facts} GROUP BY 1")
def _(t):
    return N.level_distribution(t("complaint_facts"), "severity_level")


@query("N07_sentiment_distribution", "SELECT sentiment_category, count(*) AS n FROM {complaint_facts} GROUP BY 1")
def _(t):
    return N.level_distribution(t("complaint_facts"), "sentiment_category")


@query(
    "N08_sentiment_ranking", "SELECT make, round(avg(sentiment_score), 3) AS avg_sentiment FROM {complaint_facts} GROUP BY 1"
)
def _(t):
    return N.sentiment_ranking(t("complaint_facts"))


CRITICAL = """SELECT complaint_id, make, sentiment_score, safety_keyword_count FROM {complaint_facts}
    WHERE sentiment_category = 'VERY_NEGATIVE' AND safety_keyword_count >= 3"""


@query("N09_safety_critical", CRITICAL)
def _(t):
    return N.safety_critical(t("complaint_facts")).select(
        "complaint_id", "make", "sentiment_score", "safety_keyword_count"
    )


@query("N09_safety_critical_of_make", CRITICAL + " AND make = 'Honda'")
def _(t):
    return N.safety_critical(t("complaint_facts"), "Honda").select(
        "complaint_id", "make", "sentiment_score", "safety_keyword_count"
    )


@query(
    "N10_very_negative_per_make",
    "SELECT make, count(*) AS very_neg_count FROM {complaint_facts} WHERE sentiment_category = 'VERY_NEGATIVE' GROUP BY 1",
)
def _(t):
    return N.very_negative_per_make(t("complaint_facts"))


@query(
    "N11_top_recall_makes",
    "SELECT make, count(*) AS recall_count FROM {recall_facts} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def _(t):
    return N.top_recall_makes(t("recall_facts"))


@query(
    "N11_recalls_of_make", "SELECT year, count(*) AS recall_count FROM {recall_facts} WHERE make = 'Tesla' GROUP BY 1"
)
def _(t):
    return N.recalls_of_make(t("recall_facts"), "Tesla")


@query(
    "N12_mean_mpg_per_make",
    "SELECT make, round(avg(mpg_combined), 6) AS avg_mpg FROM {fuel_facts} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def _(t):
    return r6(N.mean_mpg_per_make(t("fuel_facts")), "avg_mpg")


@query("N12_mpg_trend", "SELECT year, round(avg(mpg_combined), 6) AS avg_mpg FROM {fuel_facts} WHERE NOT is_electric GROUP BY 1")
def _(t):
    return r6(N.mpg_trend(t("fuel_facts")), "avg_mpg")


@query("N13_electric_by_range", "SELECT fuel_economy_id, make, electric_range FROM {fuel_facts} WHERE is_electric")
def _(t):
    return N.electric_by_range(t("fuel_facts")).select("fuel_economy_id", "make", "electric_range")


@query(
    "N14_latest_months",
    "SELECT date, round(total_vehicle_sales, 2) AS total_vehicle_sales FROM {economic_facts} ORDER BY date DESC LIMIT 12",
)
def _(t):
    return N.latest_months(t("economic_facts")).withColumn("total_vehicle_sales", F.round("total_vehicle_sales", 2))


@query(
    "N14_yearly_sales",
    """SELECT CAST(year(date) AS INTEGER) AS year, round(avg(total_vehicle_sales), 4) AS avg_sales FROM {economic_facts}
    GROUP BY 1""",
)
def _(t):
    return N.yearly_sales(t("economic_facts")).withColumn("avg_sales", F.round("avg_sales", 4))


@query(
    "N14_sales_since",
    "SELECT date, round(total_vehicle_sales, 2) AS total_vehicle_sales FROM {economic_facts} WHERE year(date) >= 2000",
)
def _(t):
    return N.sales_since(t("economic_facts"), 2000).withColumn("total_vehicle_sales", F.round("total_vehicle_sales", 2))


@query(
    "N15_sentiment_trend",
    """SELECT year, round(avg(sentiment_score), 6) AS avg_sentiment, count(*) AS n FROM {complaint_facts}
    WHERE make = 'Tesla' GROUP BY 1""",
)
def _(t):
    return r6(N.sentiment_trend(t("complaint_facts"), "Tesla"), "avg_sentiment")


@query(
    "N16_compare_sentiment",
    """SELECT make, round(avg(sentiment_score), 6) AS avg_sentiment, count(*) AS n FROM {complaint_facts}
    WHERE make IN ('Tesla', 'Honda') GROUP BY 1""",
)
def _(t):
    return r6(N.compare_sentiment(t("complaint_facts"), ["Tesla", "Honda"]), "avg_sentiment")


@query(
    "N17_sentiment_by_drive",
    """SELECT is_electric, round(avg(sentiment_score), 6) AS avg_sentiment, count(*) AS n FROM {complaint_facts} c
    JOIN (SELECT vehicle_id, bool_or(is_electric) AS is_electric FROM {fuel_facts} GROUP BY 1) f
    ON c.vehicle_id = f.vehicle_id GROUP BY 1""",
)
def _(t):
    return r6(N.sentiment_by_drive(t("complaint_facts"), t("fuel_facts")), "avg_sentiment")


@query("N18_scorecard", SCORECARD)
def _(t):
    return r6(N.scorecard(t("recall_facts"), t("rating_facts"), t("complaint_facts")), "avg_rating", "avg_sentiment")
