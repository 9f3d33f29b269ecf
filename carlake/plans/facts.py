"""The six fact tables. Each cleaning job is a chain of wide selects with one shuffle, for keep-one."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from carlake import rules
from carlake.functions import cleaning as C
from carlake.functions import derived as D
from carlake.functions import text as T
from carlake.operators.filters import filter_year_window, keep_names, select_available, to_fact
from carlake.operators.reshape import dedup, dedup_documents, pivot_series
from carlake.sources.sinks import csv_path, replace_table, write_csv


def _col(df: DataFrame, name: str, kind: str = "string") -> Column:
    """The column, or NULL where the raw file lacks it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _vehicle_key() -> Column:
    return D.surrogate_key([F.col("make"), F.col("model"), F.col("year")])


def clean_complaints(
    raw: DataFrame,
    as_of: datetime,
    years: tuple[int, int] = (2020, 2025),
    embedding_dim: int | None = 768,
    makers: Sequence[str] = rules.MAKERS,
) -> DataFrame:
    """Complaint facts with sentiment. Rows are filtered before, and text is analysed after, keep-one."""
    year = C.to_int(_col(raw, "YEARTXT_clean")) if "YEARTXT_clean" in raw.columns else C.clean_year(F.col("YEARTXT"))
    maker = C.first_name(C.standardize_name(F.col("MAKETXT")), C.standardize_name(F.col("MFR_NAME")))
    fields = [
        "CMPLID", "MODELTXT", "FAILDATE", "DATEA", "MILES", "VEH_SPEED", "COMPDESC", "CRASH", "FIRE", "INJURED",
        "DEATHS", "CDESCR", "VIN", "DRIVE_TRAIN", "FUEL_TYPE", "ORIG_OWNER_YN", "REPAIRED_YN", "VEHICLES_TOWED_YN",
    ]
    rows = raw.select(maker.alias("make"), year.alias("year"), *[_col(raw, c).alias(c) for c in fields])
    rows = keep_names(filter_year_window(rows, "year", *years), "make", makers)
    rows = dedup(rows, ["CMPLID"])
    typed = rows.select(
        D.record_id(F.col("CMPLID")).alias("complaint_id"),
        F.col("CMPLID").alias("nhtsa_complaint_id"),
        "make",
        C.clean_text(F.col("MODELTXT")).alias("model"),
        "year",
        C.parse_yyyymmdd(F.col("FAILDATE")).alias("fail_date"),
        C.parse_yyyymmdd(F.col("DATEA")).alias("date_added"),
        C.clamp_null(F.col("MILES"), 0, 500000).alias("mileage"),
        C.clamp_null(F.col("VEH_SPEED"), 0, 200).alias("vehicle_speed"),
        F.col("COMPDESC").alias("component_description"),
        C.yn_to_bool(F.col("CRASH")).alias("crash_flag"),
        C.yn_to_bool(F.col("FIRE")).alias("fire_flag"),
        C.null_to_zero_int(F.col("INJURED")).alias("injured"),
        C.null_to_zero_int(F.col("DEATHS")).alias("deaths"),
        C.clean_text(F.col("CDESCR")).alias("complaint_description"),
        F.col("VIN").alias("vin"),
        F.col("DRIVE_TRAIN").alias("drive_train"),
        F.col("FUEL_TYPE").alias("fuel_type"),
        C.yn_to_bool(F.col("ORIG_OWNER_YN")).alias("is_original_owner"),
        C.yn_to_bool(F.col("REPAIRED_YN")).alias("was_repaired"),
        C.yn_to_bool(F.col("VEHICLES_TOWED_YN")).alias("was_towed"),
    )
    scored = T.with_sentiment(typed, "complaint_description")
    if embedding_dim:
        scored = T.embed_text(scored, "complaint_description", embedding_dim, "complaint_embedding")
    incident = [F.col(c) for c in ("deaths", "injured", "crash_flag", "fire_flag")]
    spec = [
        ("complaint_id", "complaint_id"), ("nhtsa_complaint_id", "nhtsa_complaint_id"), ("vehicle_id", _vehicle_key()),
        *[(c, c) for c in ("make", "model", "year", "fail_date", "date_added", "mileage", "vehicle_speed")],
        *[(c, c) for c in ("component_description", "crash_flag", "fire_flag", "injured", "deaths")],
        ("has_incident", D.has_incident(*incident)),
        ("severity_level", D.severity(*incident)),
        ("complaint_description", "complaint_description"),
        *[(c, c) for c in ("sentiment_score", "sentiment_label", "sentiment_confidence")],
        ("sentiment_category", D.sentiment_band(F.col("sentiment_score"))),
        *([("complaint_embedding", "complaint_embedding")] if embedding_dim else []),
        *[(c, c) for c in ("negation_count", "safety_keyword_count", "vin", "drive_train", "fuel_type")],
        *[(c, c) for c in ("is_original_owner", "was_repaired", "was_towed")],
        ("missing_critical_data", D.missing_any([F.col(c) for c in ("make", "year", "complaint_description")])),
    ]
    facts = to_fact(scored, spec)
    return facts.select("*", *C.lineage("NHTSA_COMPLAINTS", as_of))


def clean_investigations(
    raw: DataFrame,
    as_of: datetime,
    keys: Sequence[str] = ("NHTSA_ACTION_NUMBER",),
    makers: Sequence[str] = rules.MAKERS,
) -> DataFrame:
    rows = select_available(raw, rules.INVESTIGATION_FIELDS).withColumn("_make", C.standardize_name(F.col("MAKE")))
    rows = dedup(keep_names(rows, "_make", makers), list(keys))
    typed = rows.select(
        D.record_id(F.col("NHTSA_ACTION_NUMBER")).alias("investigation_id"),
        F.col("NHTSA_ACTION_NUMBER").alias("nhtsa_action_number"),
        F.col("_make").alias("make"),
        C.standardize_name(F.col("MFR_NAME")).alias("manufacturer_name"),
        C.clean_text(F.col("MODEL")).alias("model"),
        C.clean_year(F.col("YEAR")).alias("year"),
        F.col("COMPNAME").alias("component_name"),
        D.categorize(F.col("COMPNAME")).alias("component_category"),
        C.clean_date(F.col("ODATE")).alias("open_date"),
        C.clean_date(F.col("CDATE")).alias("close_date"),
        F.trim("CAMPNO").alias("campaign_number"),
        D.has_value(F.col("CAMPNO")).alias("has_recall"),
        C.clean_text(F.col("SUBJECT")).alias("subject"),
        C.clean_text(F.col("SUMMARY")).alias("summary"),
    )
    opened, close = F.col("open_date"), F.col("close_date")
    days = D.duration_days(opened, close)
    spec = [
        ("investigation_id", "investigation_id"), ("nhtsa_action_number", "nhtsa_action_number"),
        ("vehicle_id", _vehicle_key()),
        *[(c, c) for c in ("make", "manufacturer_name", "model", "year", "component_name", "component_category")],
        *[(c, c) for c in ("open_date", "close_date")],
        ("open_year", F.year(opened)),
        *[(c, c) for c in ("campaign_number", "has_recall", "subject", "summary")],
        ("investigation_status", D.status(close)),
        ("investigation_duration_days", days),
        ("long_investigation_flag", D.is_long(days)),
        ("missing_critical_data", D.missing_any([F.col(c) for c in ("make", "year", "component_category")])),
        ("date_inconsistency", D.out_of_order(opened, close)),
    ]
    return to_fact(typed, spec).select("*", *C.lineage("NHTSA_INVESTIGATIONS", as_of))


def clean_ratings(
    raw: DataFrame,
    as_of: datetime,
    keys: Sequence[str] = ("make", "model", "year"),
    makers: Sequence[str] = rules.MAKERS,
) -> DataFrame:
    """Rating facts, one row per ``keys``; add ``DRIVE_TRAIN`` to keep every drive train of a vehicle."""
    present = select_available(raw, rules.RATING_FIELDS)
    rows = present.select(
        C.standardize_name(F.col("MAKE")).alias("make"),
        C.clean_text(F.col("MODEL")).alias("model"),
        C.clean_year(F.col("MODEL_YR"), sentinels=()).alias("year"),
        *[c for c in present.columns if c not in ("MAKE", "MODEL", "MODEL_YR")],
    )
    rows = dedup(keep_names(rows, "make", makers), list(keys))

    stars = {
        "OVERALL_STARS": "overall_stars", "OVERALL_FRNT_STARS": "overall_front_stars",
        "OVERALL_SIDE_STARS": "overall_side_stars", "ROLLOVER_STARS": "rollover_stars",
        "FRNT_DRIV_STARS": "front_driver_stars", "FRNT_PASS_STARS": "front_passenger_stars",
        "SIDE_DRIV_STARS": "side_driver_stars", "SIDE_PASS_STARS": "side_passenger_stars",
        "SIDE_BARRIER_STAR": "_side_barrier", "SIDE_POLE_STARS": "_side_pole",
    }
    features = {
        "ABS": "has_abs", "NHTSA_ESC": "has_esc", "BLIND_SPOT_DETECTION": "has_blind_spot_detection",
        "NHTSA_BACKUP_CAMERA": "has_backup_camera", "FRNT_COLLISION_WARNING": "has_front_collision_warning",
        "LANE_DEPARTURE_WARNING": "has_lane_departure_warning", "CRASH_IMMINENT_BRAKE": "has_crash_imminent_brake",
        "DYNAMIC_BRAKE_SUPPORT": "has_dynamic_brake_support", "ADAPTIVE_CRUISE_CONTROL": "has_adaptive_cruise_control",
    }
    weights = ["CURB_WEIGHT", "MIN_GROSS_WEIGHT", "MAX_GROSS_WEIGHT"]
    # typed values first, so that each is computed once for its own column, the mean and the count
    typed = rows.select(
        "make", "model", "year", _vehicle_key().alias("vehicle_id"),
        C.norm_label(_col(rows, "BODY_STYLE")).alias("body_style"),
        C.upper_trim(_col(rows, "VEHICLE_CLASS")).alias("vehicle_class"),
        _col(rows, "DRIVE_TRAIN").alias("drive_train"), _col(rows, "NUM_OF_SEATING").alias("num_of_seating"),
        *[C.clamp_null(_col(rows, c), 1000, 15000).alias(c.lower()) for c in weights],
        *[C.clean_star(_col(rows, c)).alias(name) for c, name in stars.items()],
        *[C.feature_flag(_col(rows, c)).alias(name) for c, name in features.items()],
    )
    staged = typed.select(
        "*", D.row_mean([F.col(c) for c in stars.values()]).alias("average_star_rating"),
        D.count_true([F.col(features[c]) for c in rules.ADVANCED_FEATURES]).alias("advanced_safety_count"),
    )
    mean = F.col("average_star_rating")
    shown = [c for c in stars.values() if not c.startswith("_")]
    spec = [
        ("rating_id", D.surrogate_key([F.col("vehicle_id"), F.col("drive_train")])),
        *[(c, c) for c in ("vehicle_id", "make", "model", "year", "body_style", "vehicle_class", "drive_train")],
        ("num_of_seating", "num_of_seating"), *[(c.lower(), c.lower()) for c in weights],
        *[(c, c) for c in shown], ("average_star_rating", mean), ("safety_tier", D.safety_tier(mean)),
        *[(c, c) for c in features.values()],
        ("has_advanced_safety", F.col("advanced_safety_count") >= 2), ("advanced_safety_count", "advanced_safety_count"),
        ("missing_critical_data", D.missing_any([F.col("make"), F.col("year")])),
        ("has_test_data", mean.isNotNull()),
    ]
    return to_fact(staged, spec).select("*", *C.lineage("NHTSA_RATINGS", as_of))


RECALL_DOCUMENTS = ["RCLRPT", "RCMN", "RCAK"]


def clean_recalls(
    raw: DataFrame,
    as_of: datetime,
    primary: Sequence[str] = tuple(RECALL_DOCUMENTS),
    makers: Sequence[str] = rules.MAKERS,
) -> DataFrame:
    """Recall facts out of one row per document; the main document of each recall is kept."""
    rows = raw.select(
        "recall_id", C.standardize_name(F.col("make")).alias("make"), C.clean_text(F.col("model")).alias("model"),
        C.clean_year(F.col("year")).alias("year"), C.clean_text(F.col("summary")).alias("recall_summary"),
        C.upper_trim(F.col("document_type")).alias("document_type"), "document_url",
    )
    rows = dedup_documents(keep_names(rows, "make", makers), "recall_id", "document_type", primary)
    spec = [
        ("recall_id", D.record_id(F.col("recall_id"))), ("nhtsa_recall_id", "recall_id"),
        ("vehicle_id", _vehicle_key()), ("make", "make"), ("model", "model"), ("year", "year"),
        ("recall_summary", "recall_summary"), ("document_type", "document_type"),
        ("primary_document", "document_url"),
        ("missing_critical_data", D.missing_any([F.col("make"), F.col("recall_summary")])),
        ("has_year_data", F.col("year").isNotNull()),
    ]
    return to_fact(rows, spec).select("*", *C.lineage("NHTSA_RECALLS", as_of))


def clean_fuel_economy(
    raw: DataFrame,
    as_of: datetime,
    years: tuple[int, int] = (2020, 2025),
    zero_is_null: bool = False,
    invalid: Observation | None = None,
    makers: Sequence[str] = rules.MAKERS,
) -> DataFrame:
    rows = raw.select(
        "*", C.standardize_name(F.col("make")).alias("_make"), C.to_int(F.col("year")).alias("_year")
    )
    rows = dedup(filter_year_window(keep_names(rows, "_make", makers), "_year", *years, invalid), ["epa_id"])
    typed = rows.select(
        *[c for c in rows.columns if c not in ("make", "model", "year", "_make", "_year")],
        F.col("_make").alias("make"), C.clean_text(F.col("model")).alias("model"), F.col("_year").alias("year"),
    )
    first, second = F.col("fuel_type1"), F.col("fuel_type2")
    mpge, mpg = F.col("mpge_combined").try_cast("double"), F.col("mpg_combined").try_cast("double")
    spec = [
        ("fuel_economy_id", D.record_id(F.col("epa_id"))), ("epa_id", "epa_id"), ("vehicle_id", _vehicle_key()),
        ("make", "make"), ("model", "model"), ("year", "year"), ("vehicle_class", "vehicle_class"),
        ("fuel_type", "fuel_type"), ("primary_fuel_type", "fuel_type1"), ("secondary_fuel_type", "fuel_type2"),
        ("fuel_category", D.fuel_category(first, second)),
        *[(c, C.to_int(F.col(c))) for c in ("mpg_city", "mpg_highway", "mpg_combined")],
        ("mpge_combined", mpge), ("electric_range", C.to_int(F.col("electric_range"))),
        ("efficiency_score", D.first_metric(mpge, mpg, zero_is_null)),
        ("cylinders", C.to_int(F.col("cylinders"))), ("drive_train", "drive_type"), ("transmission", "transmission"),
        ("greenhouse_gas_score", C.to_int(F.col("greenhouse_gas_score"))),
        ("co2_tailpipe", F.col("co2_tailpipe_gpm").try_cast("double")),
        ("is_electric", D.is_value(first, "Electricity")), ("is_hybrid", D.is_value(second, "Electricity")),
        ("is_flex_fuel", D.is_value(second, "E85")),
    ]
    return to_fact(typed, spec).select("*", *C.lineage("EPA_FUEL_ECONOMY", as_of))


def clean_economic(raw: DataFrame, as_of: datetime) -> DataFrame:
    """Monthly indicators, wide; the order of rows is left to the reader."""
    rows = raw.select(F.try_to_date("date", "yyyy-MM-dd").alias("date"), "series_id", C.to_number(F.col("value")).alias("value"))
    wide = pivot_series(rows, "date", "series_id", "value", rules.SERIES_COLUMNS)
    return wide.select("*", F.lit("FRED").alias("data_source"), F.lit(as_of).cast("timestamp_ntz").alias("loaded_at"))


def run(
    raw: DataFrame,
    clean: Callable[[DataFrame], DataFrame],
    path: str,
    csv: bool = True,
    partition_by: Sequence[str] = (),
) -> dict[str, int | float]:
    """Cleans and writes a fact table; two jobs in all. ``partition_by`` (year) lets later reads skip files.

    The counts come out of the write itself; a run that fails leaves the table of the one before. The CSV is made from the written table, so the raw files are
    read and cleaned once."""
    before, after = Observation(), Observation()
    facts = clean(raw.observe(before, F.count(F.lit(1)).alias("rows")))
    replace_table(facts.observe(after, F.count(F.lit(1)).alias("rows")), path, partition_by)
    if csv:
        write_csv(raw.sparkSession.read.parquet(path), csv_path(path) if "/parquet/" in path else path + "-csv")
    initial, final = before.get["rows"], after.get["rows"]
    return {
        "initial_rows": initial,
        "final_rows": final,
        "removed_rows": initial - final,
        "retention_pct": round(100.0 * final / initial, 1) if initial else 0.0,
    }
