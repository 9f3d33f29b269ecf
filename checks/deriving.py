"""D and R operators, set operations and the six cleaning jobs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from carlake import rules
from carlake.functions import cleaning as C
from carlake.functions import derived as D
from carlake.operators import reshape as R
from carlake.plans import facts
from checks import sqlparts as S
from checks import tagging as T
from checks.registry import query

AS_OF = datetime(2026, 1, 1)
LINEAGE = "TIMESTAMP '2026-01-01 00:00:00' AS processed_at, '{}' AS data_source, '1.0' AS processing_version"

# Complaint flags and counts, typed once.
TYPED = f"""(SELECT CMPLID, {S.yn('CRASH')} AS crash, {S.yn('FIRE')} AS fire, {S.count('INJURED')} AS injured,
    {S.count('DEATHS')} AS deaths FROM {{complaints_raw}})"""


def typed(t):
    return t("complaints_raw").select(
        "CMPLID", C.yn_to_bool(F.col("CRASH")).alias("crash"), C.yn_to_bool(F.col("FIRE")).alias("fire"),
        C.null_to_zero_int(F.col("INJURED")).alias("injured"), C.null_to_zero_int(F.col("DEATHS")).alias("deaths"),
    )


INCIDENT = ["deaths", "injured", "crash", "fire"]


@query("D01_severity", f"SELECT CMPLID, {S.severity(*INCIDENT)} AS severity_level FROM {TYPED}")
def _(t):
    return typed(t).select("CMPLID", D.severity(*[F.col(c) for c in INCIDENT]).alias("severity_level"))


@query(
    "D02_has_incident",
    f"SELECT CMPLID, coalesce(crash OR fire OR injured > 0 OR deaths > 0, false) AS has_incident FROM {TYPED}",
)
def _(t):
    return typed(t).select("CMPLID", D.has_incident(*[F.col(c) for c in INCIDENT]).alias("has_incident"))


@query("D03_categorize", f"SELECT CMPLID, COMPDESC, {S.component('COMPDESC')} AS category FROM {{complaints_raw}}")
def _(t):
    return t("complaints_raw").select("CMPLID", "COMPDESC", D.categorize(F.col("COMPDESC")).alias("category"))


DATES = f"(SELECT SUMMARY, {S.date('ODATE')} AS opened, {S.date('CDATE')} AS closed FROM {{investigations_raw}})"


def dates(t):
    return t("investigations_raw").select(
        "SUMMARY", C.clean_date(F.col("ODATE")).alias("opened"), C.clean_date(F.col("CDATE")).alias("closed")
    )


@query("D04_status", f"SELECT SUMMARY, CASE WHEN closed IS NULL THEN 'OPEN' ELSE 'CLOSED' END AS status FROM {DATES}")
def _(t):
    return dates(t).select("SUMMARY", D.status(F.col("closed")).alias("status"))


@query(
    "D05_duration",
    f"""SELECT SUMMARY, CAST(closed - opened AS INTEGER) AS days, coalesce(closed - opened > 365, false) AS is_long,
    CAST(year(opened) AS INTEGER) AS open_year FROM {DATES}""",
)
def _(t):
    days = D.duration_days(F.col("opened"), F.col("closed"))
    return dates(t).select(
        "SUMMARY", days.alias("days"), D.is_long(days).alias("is_long"), F.year("opened").alias("open_year")
    )


@query(
    "D06_has_value",
    """SELECT SUMMARY, CAMPNO, coalesce(trim(CAMPNO) <> '', false) AS has_recall, trim(CAMPNO) AS campaign_number
    FROM {investigations_raw}""",
)
def _(t):
    return t("investigations_raw").select(
        "SUMMARY", "CAMPNO", D.has_value(F.col("CAMPNO")).alias("has_recall"), F.trim("CAMPNO").alias("campaign_number")
    )


@query(
    "D07_quality_flags",
    f"""SELECT SUMMARY, opened IS NULL OR closed IS NULL AS missing_critical_data,
    coalesce(closed < opened, false) AS date_inconsistency FROM {DATES}""",
)
def _(t):
    opened, closed = F.col("opened"), F.col("closed")
    return dates(t).select(
        "SUMMARY", D.missing_any([opened, closed]).alias("missing_critical_data"),
        D.out_of_order(opened, closed).alias("date_inconsistency"),
    )


FUEL = """CASE WHEN fuel_type1 = 'Electricity' THEN 'Electric' WHEN fuel_type2 = 'Electricity' THEN 'Plug-in Hybrid'
    WHEN fuel_type2 = 'E85' THEN 'Flex-Fuel' WHEN fuel_type1 LIKE '%Diesel%' THEN 'Diesel'
    WHEN fuel_type1 LIKE '%Gasoline%' THEN 'Gasoline' ELSE 'Other' END"""


@query("D08_fuel_category", f"SELECT epa_id, fuel_type1, fuel_type2, {FUEL} AS fuel_category FROM {{fuel_raw}}")
def _(t):
    category = D.fuel_category(F.col("fuel_type1"), F.col("fuel_type2"))
    return t("fuel_raw").select("epa_id", "fuel_type1", "fuel_type2", category.alias("fuel_category"))


@query(
    "D09_first_metric",
    """SELECT epa_id, coalesce(TRY_CAST(mpge_combined AS DOUBLE), TRY_CAST(mpg_combined AS DOUBLE)) AS score,
    coalesce(nullif(TRY_CAST(mpge_combined AS DOUBLE), 0), TRY_CAST(mpg_combined AS DOUBLE)) AS score_without_zero
    FROM {fuel_raw}""",
)
def _(t):
    a, b = F.col("mpge_combined").try_cast("double"), F.col("mpg_combined").try_cast("double")
    return t("fuel_raw").select(
        "epa_id", D.first_metric(a, b).alias("score"), D.first_metric(a, b, True).alias("score_without_zero")
    )


@query(
    "D10_is_value",
    """SELECT epa_id, coalesce(fuel_type1 = 'Electricity', false) AS is_electric,
    coalesce(fuel_type2 = 'Electricity', false) AS is_hybrid, coalesce(fuel_type2 = 'E85', false) AS is_flex_fuel
    FROM {fuel_raw}""",
)
def _(t):
    return t("fuel_raw").select(
        "epa_id", D.is_value(F.col("fuel_type1"), "Electricity").alias("is_electric"),
        D.is_value(F.col("fuel_type2"), "Electricity").alias("is_hybrid"),
        D.is_value(F.col("fuel_type2"), "E85").alias("is_flex_fuel"),
    )


FOUR = ["OVERALL_STARS", "OVERALL_FRNT_STARS", "ROLLOVER_STARS", "FRNT_PASS_STARS"]
MEAN = (
    "(" + " + ".join(f"coalesce({S.star(c)}, 0)" for c in FOUR) + ") / nullif("
    + " + ".join(f"CASE WHEN {S.star(c)} IS NULL THEN 0 ELSE 1 END" for c in FOUR) + ", 0)"
)
TIER = """CASE WHEN m IS NULL THEN 'NOT_RATED' WHEN m >= 4.5 THEN 'EXCELLENT' WHEN m >= 4 THEN 'GOOD'
    WHEN m >= 3 THEN 'ACCEPTABLE' WHEN m >= 2 THEN 'MARGINAL' ELSE 'POOR' END"""


def four_star_mean():
    return D.row_mean([C.clean_star(F.col(c)) for c in FOUR])


@query("D11_row_mean", f"SELECT MAKE, MODEL_YR, round({MEAN}, 6) AS mean_stars FROM {{ratings_raw}}")
def _(t):
    return t("ratings_raw").select("MAKE", "MODEL_YR", F.round(four_star_mean(), 6).alias("mean_stars"))


@query("D12_band", f"SELECT MAKE, MODEL_YR, {TIER} AS safety_tier FROM (SELECT *, {MEAN} AS m FROM {{ratings_raw}})")
def _(t):
    return t("ratings_raw").select("MAKE", "MODEL_YR", D.safety_tier(four_star_mean()).alias("safety_tier"))


ADVANCED = " + ".join(f"CASE WHEN {S.feature(c)} THEN 1 ELSE 0 END" for c in rules.ADVANCED_FEATURES)


@query(
    "D13_count_true",
    f"SELECT MAKE, MODEL_YR, {ADVANCED} AS advanced_count, {ADVANCED} >= 2 AS has_advanced FROM {{ratings_raw}}",
)
def _(t):
    n = D.count_true([C.feature_flag(F.col(c)) for c in rules.ADVANCED_FEATURES])
    return t("ratings_raw").select("MAKE", "MODEL_YR", n.alias("advanced_count"), (n >= 2).alias("has_advanced"))


@query(
    "D14_sentiment_band",
    """SELECT complaint_id, CASE WHEN s < -0.5 THEN 'VERY_NEGATIVE' WHEN s < -0.2 THEN 'NEGATIVE' WHEN s < 0.2 THEN 'NEUTRAL'
    WHEN s < 0.5 THEN 'POSITIVE' WHEN s >= 0.5 THEN 'VERY_POSITIVE' END AS category
    FROM (SELECT *, CASE WHEN year = 2020 THEN NULL ELSE sentiment_score END AS s FROM {complaint_facts})""",
)
def _(t):
    score = F.when(F.col("year") != 2020, F.col("sentiment_score"))
    return t("complaint_facts").select("complaint_id", D.sentiment_band(score).alias("category"))


@query("D15_surrogate_key", f"SELECT MAKE, MODEL, MODEL_YR, {S.key('MAKE', 'MODEL', 'MODEL_YR')} AS vehicle_id FROM {{ratings_raw}}")
def _(t):
    cols = ["MAKE", "MODEL", "MODEL_YR"]
    return t("ratings_raw").select(*cols, D.surrogate_key([F.col(c) for c in cols]).alias("vehicle_id"))


@query("D16_record_id", "SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR)) AS order_id FROM orders")
def _(t):
    return t("orders").select("o_orderkey", D.record_id(F.col("o_orderkey")).alias("order_id"))


# --- cleaning jobs --------------------------------------------------------------------------


def first_row(source: str, keys: str, columns: list[str]) -> str:
    order = ", ".join(f"{c} NULLS FIRST" for c in columns)
    return (
        f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS _rn FROM {source}) "
        "WHERE _rn = 1)"
    )


RECALLS = f"""
WITH typed AS (
  SELECT recall_id, {S.names('make')} AS make, {S.clean('model')} AS model, {S.year('year')} AS year,
    {S.clean('summary')} AS recall_summary, upper(trim(document_type)) AS document_type, document_url
  FROM {{recalls_raw}}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY recall_id ORDER BY CASE document_type WHEN 'RCLRPT' THEN 0 WHEN 'RCMN' THEN 1
    WHEN 'RCAK' THEN 2 ELSE 3 END, make NULLS FIRST, model NULLS FIRST, year NULLS FIRST, recall_summary NULLS FIRST,
    document_type NULLS FIRST, document_url NULLS FIRST) AS rn
  FROM typed WHERE make IN {S.MAKERS})
SELECT sha256(recall_id) AS recall_id, recall_id AS nhtsa_recall_id, {S.key('make', 'model', 'year')} AS vehicle_id,
  make, model, year, recall_summary, document_type, document_url AS primary_document,
  make IS NULL OR recall_summary IS NULL AS missing_critical_data, year IS NOT NULL AS has_year_data,
  {LINEAGE.format('NHTSA_RECALLS')}
FROM ranked WHERE rn = 1"""


@query("D17_clean_recalls", RECALLS)
def _(t):
    return facts.clean_recalls(t("recalls_raw"), AS_OF)


INV_ORDER = ["MAKE", "MODEL", "YEAR", "COMPNAME", "MFR_NAME", "ODATE", "CDATE", "CAMPNO", "SUBJECT", "SUMMARY", "_make"]
INVESTIGATIONS = f"""
WITH one AS {first_row(f"(SELECT *, {S.names('MAKE')} AS _make FROM {{investigations_raw}} WHERE {S.names('MAKE')} IN {S.MAKERS})",
                       "NHTSA_ACTION_NUMBER", INV_ORDER)},
typed AS (
  SELECT NHTSA_ACTION_NUMBER AS nr, _make AS mk, {S.names('MFR_NAME')} AS manufacturer_name, {S.clean('MODEL')} AS md,
    {S.year('YEAR')} AS yr, COMPNAME AS component_name, {S.component('COMPNAME')} AS component_category,
    {S.date('ODATE')} AS open_date, {S.date('CDATE')} AS close_date, trim(CAMPNO) AS campaign_number,
    coalesce(trim(CAMPNO) <> '', false) AS has_recall, {S.clean('SUBJECT')} AS sj, {S.clean('SUMMARY')} AS sm
  FROM one)
SELECT sha256(nr) AS investigation_id, nr AS nhtsa_action_number, {S.key('mk', 'md', 'yr')} AS vehicle_id, mk AS make,
  manufacturer_name, md AS model, yr AS year, component_name, component_category, open_date, close_date,
  CAST(year(open_date) AS INTEGER) AS open_year, campaign_number, has_recall, sj AS subject, sm AS summary,
  CASE WHEN close_date IS NULL THEN 'OPEN' ELSE 'CLOSED' END AS investigation_status,
  CAST(close_date - open_date AS INTEGER) AS investigation_duration_days,
  coalesce(close_date - open_date > 365, false) AS long_investigation_flag,
  mk IS NULL OR yr IS NULL OR component_category IS NULL AS missing_critical_data,
  coalesce(close_date < open_date, false) AS date_inconsistency, {LINEAGE.format('NHTSA_INVESTIGATIONS')}
FROM typed"""


@query("P18_investigation_facts", INVESTIGATIONS)
def _(t):
    return facts.clean_investigations(t("investigations_raw"), AS_OF)


RATING_REST = [
    "BODY_STYLE", "VEHICLE_CLASS", "DRIVE_TRAIN", "NUM_OF_SEATING", "CURB_WEIGHT", "MIN_GROSS_WEIGHT", "MAX_GROSS_WEIGHT",
    "OVERALL_STARS", "OVERALL_FRNT_STARS", "OVERALL_SIDE_STARS", "ROLLOVER_STARS", "FRNT_DRIV_STARS", "FRNT_PASS_STARS",
    "SIDE_DRIV_STARS", "SIDE_PASS_STARS", "ABS", "NHTSA_ESC", "BLIND_SPOT_DETECTION", "NHTSA_BACKUP_CAMERA",
    "FRNT_COLLISION_WARNING", "LANE_DEPARTURE_WARNING", "CRASH_IMMINENT_BRAKE", "DYNAMIC_BRAKE_SUPPORT",
    "ADAPTIVE_CRUISE_CONTROL",
]
STARS_OUT = {
    "OVERALL_STARS": "overall_stars", "OVERALL_FRNT_STARS": "overall_front_stars",
    "OVERALL_SIDE_STARS": "overall_side_stars", "ROLLOVER_STARS": "rollover_stars",
    "FRNT_DRIV_STARS": "front_driver_stars", "FRNT_PASS_STARS": "front_passenger_stars",
    "SIDE_DRIV_STARS": "side_driver_stars", "SIDE_PASS_STARS": "side_passenger_stars",
}
FLAGS_OUT = {
    "ABS": "has_abs", "NHTSA_ESC": "has_esc", "BLIND_SPOT_DETECTION": "has_blind_spot_detection",
    "NHTSA_BACKUP_CAMERA": "has_backup_camera", "FRNT_COLLISION_WARNING": "has_front_collision_warning",
    "LANE_DEPARTURE_WARNING": "has_lane_departure_warning", "CRASH_IMMINENT_BRAKE": "has_crash_imminent_brake",
    "DYNAMIC_BRAKE_SUPPORT": "has_dynamic_brake_support", "ADAPTIVE_CRUISE_CONTROL": "has_adaptive_cruise_control",
}
EIGHT = list(STARS_OUT)
RATINGS = f"""
WITH named AS (SELECT {S.names('MAKE')} AS mk, {S.clean('MODEL')} AS md, {S.year('MODEL_YR')} AS yr,
    {', '.join(RATING_REST)} FROM {{ratings_raw}}),
one AS {first_row(f"(SELECT * FROM named WHERE mk IN {S.MAKERS})", "mk, md, yr", RATING_REST)},
scored AS (SELECT *, {S.key('mk', 'md', 'yr')} AS vid,
    ({' + '.join(f'coalesce({S.star(c)}, 0)' for c in EIGHT)})
      / nullif({' + '.join(f'CASE WHEN {S.star(c)} IS NULL THEN 0 ELSE 1 END' for c in EIGHT)}, 0) AS m,
    {ADVANCED} AS adv FROM one)
SELECT {S.key('vid', 'DRIVE_TRAIN')} AS rating_id, vid AS vehicle_id, mk AS make, md AS model, yr AS year,
  upper(trim(regexp_replace(BODY_STYLE, '[^a-zA-Z0-9\\s]', '_', 'g'))) AS body_style,
  upper(trim(VEHICLE_CLASS)) AS vehicle_class, DRIVE_TRAIN AS drive_train, NUM_OF_SEATING AS num_of_seating,
  {S.clamp('CURB_WEIGHT', 1000, 15000)} AS curb_weight, {S.clamp('MIN_GROSS_WEIGHT', 1000, 15000)} AS min_gross_weight,
  {S.clamp('MAX_GROSS_WEIGHT', 1000, 15000)} AS max_gross_weight,
  {', '.join(f'{S.star(c)} AS {o}' for c, o in STARS_OUT.items())}, m AS average_star_rating, {TIER} AS safety_tier,
  {', '.join(f'{S.feature(c)} AS {o}' for c, o in FLAGS_OUT.items())},
  adv >= 2 AS has_advanced_safety, adv AS advanced_safety_count, mk IS NULL OR yr IS NULL AS missing_critical_data,
  m IS NOT NULL AS has_test_data, {LINEAGE.format('NHTSA_RATINGS')}
FROM scored"""


@query("P18_rating_facts", RATINGS)
def _(t):
    return facts.clean_ratings(t("ratings_raw"), AS_OF)


FUEL_REST = [
    "year", "make", "model", "vehicle_class", "fuel_type", "fuel_type1", "fuel_type2", "electric_range", "mpge_combined",
    "mpg_city", "mpg_highway", "mpg_combined", "cylinders", "drive_type", "transmission", "greenhouse_gas_score",
    "co2_tailpipe_gpm", "annual_fuel_cost",
]
FUEL_FACTS = f"""
WITH named AS (SELECT *, {S.names('make')} AS mk, {S.whole('year')} AS yr FROM {{fuel_raw}}),
one AS {first_row(f"(SELECT * FROM named WHERE mk IN {S.MAKERS} AND yr BETWEEN 2020 AND 2025)", "epa_id", FUEL_REST)},
typed AS (SELECT * EXCLUDE (make, model, year), mk AS make, {S.clean('model')} AS model, yr AS year FROM one)
SELECT sha256(epa_id) AS fuel_economy_id, epa_id, {S.key('make', 'model', 'year')} AS vehicle_id, make, model, year,
  vehicle_class, fuel_type, fuel_type1 AS primary_fuel_type, fuel_type2 AS secondary_fuel_type, {FUEL} AS fuel_category,
  {S.whole('mpg_city')} AS mpg_city, {S.whole('mpg_highway')} AS mpg_highway, {S.whole('mpg_combined')} AS mpg_combined,
  TRY_CAST(mpge_combined AS DOUBLE) AS mpge_combined, {S.whole('electric_range')} AS electric_range,
  coalesce(TRY_CAST(mpge_combined AS DOUBLE), TRY_CAST(mpg_combined AS DOUBLE)) AS efficiency_score,
  {S.whole('cylinders')} AS cylinders, drive_type AS drive_train, transmission,
  {S.whole('greenhouse_gas_score')} AS greenhouse_gas_score, TRY_CAST(co2_tailpipe_gpm AS DOUBLE) AS co2_tailpipe,
  coalesce(fuel_type1 = 'Electricity', false) AS is_electric, coalesce(fuel_type2 = 'Electricity', false) AS is_hybrid,
  coalesce(fuel_type2 = 'E85', false) AS is_flex_fuel, {LINEAGE.format('EPA_FUEL_ECONOMY')}
FROM typed"""


@query("P18_fuel_facts", FUEL_FACTS)
def _(t):
    return facts.clean_fuel_economy(t("fuel_raw"), AS_OF)


COMPLAINT_REST = [
    "make", "year", "MODELTXT", "FAILDATE", "DATEA", "MILES", "VEH_SPEED", "COMPDESC", "CRASH", "FIRE", "INJURED", "DEATHS",
    "CDESCR", "VIN", "DRIVE_TRAIN", "FUEL_TYPE", "ORIG_OWNER_YN", "REPAIRED_YN", "VEHICLES_TOWED_YN",
]
COMPLAINT_FACTS = f"""
WITH named AS (SELECT * EXCLUDE (MFR_NAME, MAKETXT, YEARTXT), coalesce({S.names('MAKETXT')}, {S.names('MFR_NAME')}) AS make,
    {S.year('YEARTXT')} AS year FROM {{complaints_raw}}),
one AS {first_row(f"(SELECT * FROM named WHERE make IN {S.MAKERS} AND year BETWEEN 2020 AND 2025)", "CMPLID", COMPLAINT_REST)},
typed AS (SELECT *, {S.clean('MODELTXT')} AS model, {S.clean('CDESCR')} AS body, {S.yn('CRASH')} AS cr, {S.yn('FIRE')} AS fr,
    {S.count('INJURED')} AS inj, {S.count('DEATHS')} AS dead FROM one),
tok AS (SELECT *, {T.TOKENS_OF.format('body')} AS t FROM typed),
{T.SUMS}, scored AS (SELECT *, CASE WHEN s IS NOT NULL THEN {T.SCORE} END AS score FROM sums)
SELECT sha256(CMPLID) AS complaint_id, CMPLID AS nhtsa_complaint_id, {S.key('make', 'model', 'year')} AS vehicle_id, make, model,
  year, {S.date8('FAILDATE')} AS fail_date, {S.date8('DATEA')} AS date_added, {S.clamp('MILES', 0, 500000)} AS mileage,
  {S.clamp('VEH_SPEED', 0, 200)} AS vehicle_speed, COMPDESC AS component_description, cr AS crash_flag, fr AS fire_flag,
  inj AS injured, dead AS deaths, coalesce(cr OR fr OR inj > 0 OR dead > 0, false) AS has_incident,
  {S.severity('dead', 'inj', 'cr', 'fr')} AS severity_level, body AS complaint_description, {T.embedding_sql('body')} AS complaint_embedding, score AS sentiment_score,
  {T.LABEL} AS sentiment_label, {T.CONFIDENCE} AS sentiment_confidence,
  CASE WHEN score < -0.5 THEN 'VERY_NEGATIVE' WHEN score < -0.2 THEN 'NEGATIVE' WHEN score < 0.2 THEN 'NEUTRAL'
    WHEN score < 0.5 THEN 'POSITIVE' WHEN score >= 0.5 THEN 'VERY_POSITIVE' END AS sentiment_category,
  CAST(len(list_filter(t, lambda w: w IN {S.in_list(rules.NEGATORS)})) AS INTEGER) AS negation_count,
  CAST(len(list_filter(t, lambda w: w IN {S.in_list(rules.SAFETY_WORDS)})) AS INTEGER) AS safety_keyword_count,
  VIN AS vin, DRIVE_TRAIN AS drive_train, FUEL_TYPE AS fuel_type, {S.yn('ORIG_OWNER_YN')} AS is_original_owner,
  {S.yn('REPAIRED_YN')} AS was_repaired, {S.yn('VEHICLES_TOWED_YN')} AS was_towed,
  make IS NULL OR year IS NULL OR body IS NULL AS missing_critical_data, {LINEAGE.format('NHTSA_COMPLAINTS')}
FROM scored"""


@query("P18_complaint_facts", COMPLAINT_FACTS)
def _(t):
    made = facts.clean_complaints(t("complaints_raw"), AS_OF, embedding_dim=T.EMBEDDING_DIM)
    return made.withColumn("complaint_embedding", T.embedding_digest("complaint_embedding"))


# --- reshape --------------------------------------------------------------------------------

LINE_REST = [
    "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    "l_shipdate",
]


@query(
    "R01_dedup",
    f"SELECT * EXCLUDE (_rn) FROM {first_row('lineitem', 'l_orderkey, l_linenumber', LINE_REST)}",
)
def _(t):
    return R.dedup(t("lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "R02_dedup_documents",
    """SELECT recall_id, document_type, document_url, n AS document_count FROM (
    SELECT *, count(*) OVER (PARTITION BY recall_id) AS n, row_number() OVER (PARTITION BY recall_id ORDER BY
      CASE document_type WHEN 'rclrpt' THEN 0 WHEN 'RCMN' THEN 1 ELSE 2 END, document_type, document_url) AS rn
    FROM {recalls_raw}) WHERE rn = 1""",
)
def _(t):
    df = t("recalls_raw").select("recall_id", "document_type", "document_url")
    return R.dedup_documents(df, "recall_id", "document_type", ["rclrpt", "RCMN"])


@query(
    "R03_pivot_series",
    """SELECT CAST(date AS DATE) AS date, max(v) FILTER (series_id = 'TOTALSA') AS total_vehicle_sales,
    max(v) FILTER (series_id = 'ALTSALES') AS light_truck_sales, max(v) FILTER (series_id = 'DAUTOSAAR') AS domestic_auto_sales,
    'FRED' AS data_source, TIMESTAMP '2026-01-01 00:00:00' AS loaded_at
    FROM (SELECT *, TRY_CAST(value AS DOUBLE) AS v FROM {series_raw}) GROUP BY date""",
)
def _(t):
    return facts.clean_economic(t("series_raw"), AS_OF)


@query(
    "R04_label",
    """SELECT date, value, series_id, CASE series_id WHEN 'TOTALSA' THEN 'Total Vehicle Sales'
    WHEN 'ALTSALES' THEN 'Light Truck Sales' WHEN 'DAUTOSAAR' THEN 'Domestic Auto Sales' END AS series_name FROM {series_raw}""",
)
def _(t):
    return t("series_raw").withColumn("series_name", R.label(F.col("series_id"), rules.SERIES_NAMES))


@query(
    "R05_explode_mentions",
    "SELECT event_id, unnest(participating_manufacturers) AS mention FROM {trade_events}",
)
def _(t):
    df = R.explode_mentions(t("trade_events").select("event_id", "participating_manufacturers"), "participating_manufacturers")
    return df.drop("participating_manufacturers")


@query(
    "U01_union_all",
    """SELECT substr(CAST(ts AS VARCHAR), 1, 10) AS date, value, 'click' AS series_id FROM events WHERE event_type = 'click'
    UNION ALL SELECT substr(CAST(ts AS VARCHAR), 1, 10), value, 'view' FROM events WHERE event_type = 'view'
    UNION ALL SELECT substr(CAST(ts AS VARCHAR), 1, 10), value, 'error' FROM events WHERE event_type = 'error'
    UNION ALL SELECT substr(CAST(ts AS VARCHAR), 1, 10), value, 'purchase' FROM events WHERE event_type = 'purchase'
    UNION ALL SELECT substr(CAST(ts AS VARCHAR), 1, 10), value, 'signup' FROM events WHERE event_type = 'signup'""",
)
def _(t):
    def part(kind):
        hits = t("events").filter(F.col("event_type") == kind)
        return hits.select(F.date_format("ts", "yyyy-MM-dd").alias("date"), "value", F.lit(kind).alias("series_id"))

    return R.union_all(part("click"), part("view"), part("error"), part("purchase"), part("signup")).orderBy("date", "series_id")


@query(
    "U02_array_union",
    """SELECT event_id, array_to_string(list_sort(list_distinct(list_concat(participating_manufacturers,
    split(event_type, '_')))), '|') AS names FROM {trade_events}""",
)
def _(t):
    names = R.array_union_all(F.col("participating_manufacturers"), F.split("event_type", "_"))
    return t("trade_events").select("event_id", F.array_join(names, "|").alias("names"))
