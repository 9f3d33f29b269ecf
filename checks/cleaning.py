"""P operators: filters, cleaning and the canonical projection."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from carlake import rules
from carlake.functions import cleaning as C
from carlake.functions import derived as D
from carlake.operators import filters as O
from checks import sqlparts as S
from checks.registry import query

AS_OF = datetime(2026, 1, 1)


@query("P01_standardize_name", f"SELECT CMPLID, MAKETXT, {S.names('MAKETXT')} AS make FROM {{complaints_raw}}")
def _(t):
    return O.standardize(t("complaints_raw").select("CMPLID", "MAKETXT"), "MAKETXT", out="make")


@query(
    "P02_keep_names",
    f"""SELECT CMPLID, make FROM (SELECT CMPLID, {S.names('MAKETXT')} AS make FROM {{complaints_raw}})
    WHERE make IN {S.MAKERS}""",
)
def _(t):
    df = O.standardize(t("complaints_raw"), "MAKETXT", out="make").select("CMPLID", "make")
    return O.keep_names(df, "make")


INGEST = ["Ford", "General Motors", "Mercedes-Benz", "Volkswagen", "Kia"]


@query(
    "P03_filter_names_expanded",
    """SELECT CMPLID, regexp_replace(coalesce(MAKETXT, ''), '^\\s+|\\s+$', '', 'g') AS MAKETXT FROM {complaints_raw}
    WHERE upper(regexp_replace(coalesce(MAKETXT, ''), '^\\s+|\\s+$', '', 'g')) IN ('FORD', 'GENERAL MOTORS', 'GMC',
    'GM', 'GENERAL MOTORS CORPORATION', 'MERCEDES-BENZ', 'MERCEDES BENZ', 'DAIMLER', 'DAIMLER AG', 'VOLKSWAGEN', 'VW',
    'VOLKSWAGEN GROUP', 'KIA')""",
)
def _(t):
    return O.filter_names_expanded(t("complaints_raw").select("CMPLID", "MAKETXT"), INGEST)


@query(
    "P04_filter_years",
    """SELECT CMPLID, YEARTXT, TRY_CAST(YEARTXT AS DOUBLE) AS YEARTXT_clean FROM {complaints_raw}
    WHERE TRY_CAST(YEARTXT AS DOUBLE) BETWEEN 2015 AND 2025""",
)
def _(t):
    return O.filter_years(t("complaints_raw").select("CMPLID", "YEARTXT"), 2015, 2025)


@query("P05_clean_year", f"SELECT CMPLID, {S.year('YEARTXT')} AS year FROM {{complaints_raw}}")
def _(t):
    return t("complaints_raw").select("CMPLID", C.clean_year(F.col("YEARTXT")).alias("year"))


@query(
    "P06_filter_year_window",
    f"SELECT * FROM (SELECT CMPLID, {S.year('YEARTXT')} AS year FROM {{complaints_raw}}) WHERE year BETWEEN 2020 AND 2025",
)
def _(t):
    df = t("complaints_raw").select("CMPLID", C.clean_year(F.col("YEARTXT")).alias("year"))
    return O.filter_year_window(df, "year", 2020, 2025)


@query(
    "P07_clean_date",
    f"SELECT NHTSA_ACTION_NUMBER, ODATE, {S.date('ODATE')} AS opened, {S.date('CDATE')} AS closed FROM {{investigations_raw}}",
)
def _(t):
    return t("investigations_raw").select(
        "NHTSA_ACTION_NUMBER", "ODATE", C.clean_date(F.col("ODATE")).alias("opened"),
        C.clean_date(F.col("CDATE")).alias("closed"),
    )


@query("P08_parse_yyyymmdd", f"SELECT CMPLID, {S.date8('FAILDATE')} AS fail_date FROM {{complaints_raw}}")
def _(t):
    return t("complaints_raw").select("CMPLID", C.parse_yyyymmdd(F.col("FAILDATE")).alias("fail_date"))


@query("P09_clean_text", f"SELECT page_id, {S.clean('html')} AS text FROM pages")
def _(t):
    return t("pages").select("page_id", C.clean_text(F.col("html")).alias("text"))


@query("P09_clean_text_documents", f"SELECT doc_id, {S.clean('text')} AS text FROM documents")
def _(t):
    return t("documents").select("doc_id", C.clean_text(F.col("text")).alias("text"))


@query(
    "P10_yn_to_bool",
    f"SELECT CMPLID, {S.yn('CRASH')} AS crash_flag, {S.yn('FIRE')} AS fire_flag FROM {{complaints_raw}}",
)
def _(t):
    return t("complaints_raw").select(
        "CMPLID", *[C.yn_to_bool(F.col(c)).alias(f"{c.lower()}_flag") for c in ("CRASH", "FIRE")]
    )


@query(
    "P11_null_to_zero_int",
    f"SELECT CMPLID, {S.count('INJURED')} AS injured, {S.count('DEATHS')} AS deaths FROM {{complaints_raw}}",
)
def _(t):
    return t("complaints_raw").select(
        "CMPLID", *[C.null_to_zero_int(F.col(c)).alias(c.lower()) for c in ("INJURED", "DEATHS")]
    )


@query(
    "P12_clamp_null",
    f"""SELECT CMPLID, {S.clamp('MILES', 0, 500000)} AS mileage, {S.clamp('VEH_SPEED', 0, 200)} AS vehicle_speed
    FROM {{complaints_raw}}""",
)
def _(t):
    return t("complaints_raw").select(
        "CMPLID", C.clamp_null(F.col("MILES"), 0, 500000).alias("mileage"),
        C.clamp_null(F.col("VEH_SPEED"), 0, 200).alias("vehicle_speed"),
    )


@query("P13_clean_star", f"SELECT MAKE, OVERALL_STARS, {S.star('OVERALL_STARS')} AS stars FROM {{ratings_raw}}")
def _(t):
    return t("ratings_raw").select("MAKE", "OVERALL_STARS", C.clean_star(F.col("OVERALL_STARS")).alias("stars"))


@query("P14_feature_flag", f"SELECT MAKE, ABS, {S.feature('ABS')} AS has_abs FROM {{ratings_raw}}")
def _(t):
    return t("ratings_raw").select("MAKE", "ABS", C.feature_flag(F.col("ABS")).alias("has_abs"))


@query(
    "P15_label_and_class",
    """SELECT BODY_STYLE AS raw_style, VEHICLE_CLASS AS raw_class, upper(trim(regexp_replace(BODY_STYLE, '[^a-zA-Z0-9\\s]', '_', 'g'))) AS body_style,
    upper(trim(VEHICLE_CLASS)) AS vehicle_class FROM {ratings_raw}""",
)
def _(t):
    return t("ratings_raw").select(
        F.col("BODY_STYLE").alias("raw_style"), F.col("VEHICLE_CLASS").alias("raw_class"), C.norm_label(F.col("BODY_STYLE")).alias("body_style"),
        C.upper_trim(F.col("VEHICLE_CLASS")).alias("vehicle_class"),
    )


@query("P16_select_available", "SELECT MAKE, MODEL, BODY_STYLE, CURB_WEIGHT FROM {ratings_raw}")
def _(t):
    wanted = ["MAKE", "MODEL", "VEHICLE_TYPE", "BODY_STYLE", "SIDE_POLE_STARS", "CURB_WEIGHT"]
    return O.select_available(t("ratings_raw"), wanted)


@query(
    "P17_first_name",
    f"SELECT CMPLID, coalesce({S.names('MAKETXT')}, {S.names('MFR_NAME')}) AS make FROM {{complaints_raw}}",
)
def _(t):
    return t("complaints_raw").select(
        "CMPLID",
        C.first_name(C.standardize_name(F.col("MAKETXT")), C.standardize_name(F.col("MFR_NAME"))).alias("make"),
    )


@query(
    "P18_to_fact",
    f"""SELECT sha256(CMPLID) AS complaint_id, {S.names('MAKETXT')} AS make, {S.clean('MODELTXT')} AS model,
    {S.year('YEARTXT')} AS year, COMPDESC AS component_description FROM {{complaints_raw}}""",
)
def _(t):
    spec = [
        ("complaint_id", D.record_id(F.col("CMPLID"))),
        ("make", C.standardize_name(F.col("MAKETXT"))),
        ("model", C.clean_text(F.col("MODELTXT"))),
        ("year", C.clean_year(F.col("YEARTXT"))),
        ("component_description", "COMPDESC"),
    ]
    return O.to_fact(t("complaints_raw"), spec)


@query(
    "P19_add_lineage",
    """SELECT o_orderkey, TIMESTAMP '2026-01-01 00:00:00' AS processed_at, 'ORDERS' AS data_source,
    '1.0' AS processing_version FROM orders""",
)
def _(t):
    return O.add_lineage(t("orders").select("o_orderkey"), "ORDERS", AS_OF)


@query("P20_require", "SELECT CMPLID, MAKETXT FROM {complaints_raw} WHERE MAKETXT IS NOT NULL")
def _(t):
    return O.require(t("complaints_raw").select("CMPLID", "MAKETXT"), "MAKETXT")
