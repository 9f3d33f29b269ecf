"""Inputs derived from the driver tables, in SQL that Spark and DuckDB read alike.

The driver tables hold no vehicle data, so raw rows with the needed spellings, sentinels and sentences are
picked from literal lists by the remainder of a key. Every input has one row per row of its driver table."""

from __future__ import annotations


def text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def pick(expr: str, values: list[str | None]) -> str:
    cases = " ".join(f"WHEN {i} THEN {text(v)}" for i, v in enumerate(values))
    return f"CASE ({expr}) % {len(values)} {cases} END"


def ymd(date: str, years: int = 0) -> str:
    return f"CAST((year({date}) + {years}) * 10000 + month({date}) * 100 + day({date}) AS STRING)"


# One maker has a third of the slots: a hot key.
MAKE_TEXTS = [
    "FORD", "ford", " Ford Motor Company ", "FORD MOTOR CO.", "tesla, inc.", "TOYOTA", "GM", "American Honda Motor Co.",
    "chevy", "FCA US, LLC", "Rivian", None, "MERCEDES BENZ", "Ford", "VW", "HYUNDAI MOTOR AMERICA", "KIA", "SUBARU",
    "FORD MOTOR COMPANY", "MAZDA", "BMW OF NORTH AMERICA", "Nissan", "FORD",
]
MFR_TEXTS = ["General Motors LLC", "Kia America, Inc.", "Acme Motors", None, "DAIMLER AG"]
MODEL_TEXTS = ["Model 3", "<b>F-150</b>", "  Civic ", "RAV4", "", "Bolt  EV", "X5", "<p></p>", "Ioniq 5"]
YEAR_TEXTS = ["2020", "2021", "2022", "2023", "2024", "2025", "2019", "9999", "x", "2031", None, "2022.0", "1989"]
FLAG_TEXTS = ["Y", "N", " y ", "U", None, "n", "N"]
COUNT_TEXTS = ["0", "1", None, "x", "0", "2", "0", "0", "0"]
DEATH_TEXTS = ["0", None, "0", "0", "0", "1", "0", "x", "0", "0", "0"]
COMPONENTS = [
    "SERVICE BRAKES, HYDRAULIC", "ENGINE AND ENGINE COOLING", "FUEL SYSTEM, BRAKE LINE", "AIR BAGS", "Seat belts: front",
    "ELECTRICAL SYSTEM", "STEERING", "TIRES", "FORWARD COLLISION AVOIDANCE", "VISIBILITY", None, "lane departure: assist",
    "WHEELS", "POWERTRAIN", "SUSPENSION",
]
COMPLAINTS = [
    "The brakes did not fail and never leaked.",
    "Airbag did not deploy, brake failure, crash and fire.",
    "<b>Steering</b> locked up on the highway; dangerous and unsafe!",
    "Great improved launch, no problem at all.",
    "The engine stalled without warning and we had a crash.",
    "A quiet week with   nothing to tell.",
    "Dealer can't find the issue. New battery, positive growth in range.",
    "Fatal accident: death of the driver, airbags failed, brakes failed, smoke.",
    "Won't start. Doesn't charge. Didn't get a recall notice.",
    None,
    "It was a success and a gain for us, innovative car.",
    "",
    "The tire had a blowout, then a rollover and an injury.",
]
NEWS = [
    "Ford recalls trucks after fire reports",
    "Honda CEO steps down",
    "Quarterly results lift shares",
    "New battery plant opens",
    "Units sold fall",
    "Supplier halts assembly",
    "Software update adds connected features",
    "A quiet week",
    "Recall hits electric vehicle sales",
    "A new launch delay",
    "Growth in a strong year",
    "Breaking exclusive: bankruptcy and recall",
    "Tesla announced the Model 3 in Austin, TX",
    "GM, VW and BYD electric vehicle sales",
    "Jane Smith, CEO, said F-150 output rose",
    "Toyota Motors plans an Ioniq 5 rival from Berlin plant",
    "Regulator NHTSA opens investigation into death and injury",
    "Record high profit and surge at Kia's new plant",
    "The chief of Subaru told reporters a merger is likely",
    "CEO Maria Lopez added that Detroit-based suppliers cope",
    "Developing story: a lawsuit over fraud",
    "Rivian Automotive unveiled the R1T in Normal, IL",
    "Mach-E and e-tron owners report self-driving problem",
    "Just in: layoff warning at Jeep dealership",
    "The company said Nothing about a plant",
    "Autonomous ai software from Nvidia has improved",
    "Hyundai's latest SUV wins award",
    "Weather is nice",
    "Inventory decline and market share loss at BMW",
    "Chief Financial Officer John Miller noted a partnership success in New York, NY",
    "Charging network boom is a breakthrough",
    "Nissan hires leadership from Reuters",
]
EVENT_TITLES = [
    "Canada Congress", "Detroit auto show", "Retail Forum", "Dealer summit", "CES", "Leading Women Conference",
    "Battery Expo", "EV webinar", "Motor show", "Owners meeting", "Ford Automotive day",
]
PLACES = [
    " held in Detroit, MI", " at Javits Convention Center", " in New York, NY", "", " online", " held at Chicago",
    " for dealers and retail", " on digital technology and ai tools", " with electric battery charging topics",
    " about supply chain production", " for women in leadership",
]
LOCATIONS = ["Detroit, MI", "New York, NY", None, "Tokyo", "Las Vegas, NV", "Munich"]
EVENT_KINDS = ["auto_show", "conference", "webinar", "trade_show", "forum", "event", "Congress", "tech_summit"]
MAKER_LISTS = ["Ford,Kia", "Tesla", "Kia", "CES", "BMW,Ford,Tesla"]
QUESTIONS = [
    "How many recalls does Ford have?", "Weather is nice", "show VIN list", "complaint description for Kia",
    "Which brand has the worst sentiment", "Who was driving?", "recall summary of airbag defects",
    "Compare mpg of hybrid and gas", "vehicle identification numbers please", "hello",
]
ANSWERS = [
    "Sales rose 5. Prices will likely fall. Typically costs more.",
    "Ford leads with 12 recalls. Honda has 3",
    "Experts say demand is weak. It usually rains.",
    "",
    "Industry average is 4. This is known. In general it holds.",
    "A first fact. A second fact. An estimated cost of $100 per unit.",
    "  One finding   . Studies show more.  ",
]
SQL_TEXTS = [
    "SELECT make, COUNT(*) FROM WAREHOUSE.NHTSA.FACT_RECALLS GROUP BY make LIMIT 10",
    "SELECT make, model, year FROM NHTSA.FACT_RECALLS WHERE year > 2020 LIMIT 100",
    "SELECT * FROM tesla_recalls WHERE year = 2024",
    "DELETE FROM NHTSA.FACT_RECALLS",
    "SELECT make /* main\n table */ FROM FACT_RECALLS -- top ones\nWHERE year >= 2020",
    "SELECT r.make, COUNT(*) FROM NHTSA.FACT_RECALLS r JOIN NHTSA.FACT_COMPLAINTS c ON r.make = c.make GROUP BY r.make",
    "drop  table FACT_RATINGS",
    "UPDATE FACT_RATINGS SET make = 'x'",
    "UPDATE FACT_RATINGS SET make = 'x' WHERE year = 1",
    "ALTER TABLE FACT_RATINGS ADD c int",
    "TRUNCATE FACT_RECALLS",
    "SELECT make FROM FACT_RATINGS WHERE model LIKE '%F-1%'",
    "-- DROP TABLE x\nSELECT 1 FROM EPA.FACT_FUEL_ECONOMY limit 5",
]
TIER_TEXTS = ["analyst", "manager", "executive", "guest", "analyst"]
STARS = ["5", "4", "Not Rated", "3", " N/A", "5", "2", "0", "6", None, "-", "4.5", "1"]
FEATURES = ["Standard", "optional", "YES", "No", None, " Yes "]
FUELS = ["Regular Gasoline", "Electricity", "Premium Gasoline", "Diesel", "Natural Gas", None]
FUELS2 = [None, "E85", "Electricity", None, None]
DOCUMENT_KINDS = ["RCMN", "rclrpt", "RCAK", "OTHER"]

_L = "l_orderkey"
INPUTS: dict[str, str] = {}

INPUTS["complaints_raw"] = f"""
SELECT CAST(l_orderkey * 8 + l_linenumber AS STRING) AS CMPLID,
  {pick("l_suppkey", MFR_TEXTS)} AS MFR_NAME,
  {pick("l_partkey", MAKE_TEXTS)} AS MAKETXT,
  {pick("l_partkey + l_suppkey", MODEL_TEXTS)} AS MODELTXT,
  {pick("l_orderkey + l_partkey", YEAR_TEXTS)} AS YEARTXT,
  {pick("l_partkey + l_linenumber", FLAG_TEXTS)} AS CRASH,
  CASE l_suppkey % 6 WHEN 0 THEN '00000000' WHEN 1 THEN '' WHEN 2 THEN '2024011' WHEN 3 THEN '20230229'
    ELSE {ymd("l_shipdate")} END AS FAILDATE,
  {pick("l_suppkey + l_linenumber", FLAG_TEXTS)} AS FIRE,
  {pick("l_orderkey + l_suppkey", COUNT_TEXTS)} AS INJURED,
  {pick("l_orderkey + l_linenumber", DEATH_TEXTS)} AS DEATHS,
  {pick("l_orderkey + l_partkey + l_suppkey", COMPONENTS)} AS COMPDESC,
  'V' || CAST(l_partkey AS STRING) AS VIN,
  CASE l_suppkey % 5 WHEN 0 THEN NULL ELSE {ymd("l_shipdate")} END AS DATEA,
  CASE l_partkey % 7 WHEN 0 THEN '-1' WHEN 1 THEN 'abc' WHEN 2 THEN NULL
    ELSE CAST(CAST(l_quantity AS BIGINT) * 12000 AS STRING) END AS MILES,
  {pick("l_orderkey + l_linenumber", COMPLAINTS)} AS CDESCR,
  {pick("l_linenumber", FLAG_TEXTS)} AS ORIG_OWNER_YN,
  {pick("l_partkey", ["FWD", "AWD", None])} AS DRIVE_TRAIN,
  {pick("l_suppkey", ["GS", "DS", None, "EL"])} AS FUEL_TYPE,
  CAST(CAST(l_quantity AS BIGINT) * 5 AS STRING) AS VEH_SPEED,
  {pick("l_orderkey", FLAG_TEXTS)} AS REPAIRED_YN,
  {pick("l_partkey", FLAG_TEXTS)} AS VEHICLES_TOWED_YN
FROM {{lineitem}}"""

INPUTS["investigations_raw"] = f"""
SELECT 'PE' || CAST(o_custkey AS STRING) AS NHTSA_ACTION_NUMBER,
  {pick("o_custkey", MAKE_TEXTS)} AS MAKE,
  {pick("o_orderkey", MODEL_TEXTS)} AS MODEL,
  {pick("o_orderkey", YEAR_TEXTS)} AS YEAR,
  {pick("o_orderkey", COMPONENTS)} AS COMPNAME,
  {pick("o_custkey", MFR_TEXTS)} AS MFR_NAME,
  CASE o_orderkey % 8 WHEN 0 THEN '99999999' WHEN 1 THEN '19891231' ELSE {ymd("o_orderdate")} END AS ODATE,
  CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN {ymd("o_orderdate", -1)} WHEN 2 THEN {ymd("o_orderdate", 2)}
    ELSE {ymd("o_orderdate", 1)} END AS CDATE,
  {pick("o_orderkey", ["24V001", " ", None, " 23V777 "])} AS CAMPNO,
  {pick("o_orderkey", NEWS[:9])} AS SUBJECT,
  {pick("o_orderkey", COMPLAINTS)} || ' case ' || CAST(o_orderkey AS STRING) AS SUMMARY
FROM {{orders}}"""

INPUTS["ratings_raw"] = f"""
SELECT {pick("p_partkey", MAKE_TEXTS)} AS MAKE,
  {pick("p_partkey", MODEL_TEXTS)} AS MODEL,
  {pick("p_partkey", YEAR_TEXTS)} AS MODEL_YR,
  {pick("p_partkey", ["4 DR", "SUV/Wagon", " pickup-crew ", None])} AS BODY_STYLE,
  {pick("p_size", [" sedan", "SUV ", None])} AS VEHICLE_CLASS,
  {pick("p_size", ["FWD", "AWD", "RWD"])} AS DRIVE_TRAIN,
  CAST(p_size AS STRING) AS NUM_OF_SEATING,
  CAST(p_size * 400 AS STRING) AS CURB_WEIGHT,
  CAST(p_size * 450 AS STRING) AS MIN_GROSS_WEIGHT,
  {pick("p_partkey", ["6000", "x", None, "20000", "999"])} AS MAX_GROSS_WEIGHT,
  {pick("p_partkey", STARS)} AS OVERALL_STARS,
  {pick("p_partkey + 1", STARS)} AS OVERALL_FRNT_STARS,
  {pick("p_partkey + 2", STARS)} AS OVERALL_SIDE_STARS,
  {pick("p_partkey + p_size", STARS)} AS ROLLOVER_STARS,
  {pick("p_partkey + 5", STARS)} AS FRNT_DRIV_STARS,
  {pick("p_size", STARS)} AS FRNT_PASS_STARS,
  {pick("p_size + 3", STARS)} AS SIDE_DRIV_STARS,
  {pick("p_size + 7", STARS)} AS SIDE_PASS_STARS,
  {pick("p_partkey", FEATURES)} AS ABS,
  {pick("p_size", FEATURES)} AS NHTSA_ESC,
  {pick("p_partkey + p_size", FEATURES)} AS BLIND_SPOT_DETECTION,
  {pick("p_partkey + 1", FEATURES)} AS NHTSA_BACKUP_CAMERA,
  {pick("p_size + 2", FEATURES)} AS FRNT_COLLISION_WARNING,
  {pick("p_partkey + 3", FEATURES)} AS LANE_DEPARTURE_WARNING,
  {pick("p_size + 4", FEATURES)} AS CRASH_IMMINENT_BRAKE,
  {pick("p_size + 5", FEATURES)} AS DYNAMIC_BRAKE_SUPPORT,
  {pick("p_partkey + 5", FEATURES)} AS ADAPTIVE_CRUISE_CONTROL
FROM {{part}}"""

INPUTS["recalls_raw"] = f"""
SELECT 'R' || CAST(CAST((o_orderkey - o_orderkey % 3) / 3 AS BIGINT) AS STRING) AS recall_id,
  {pick("(o_orderkey - o_orderkey % 3)", MAKE_TEXTS)} AS make,
  {pick("(o_orderkey - o_orderkey % 3)", MODEL_TEXTS)} AS model,
  {pick("(o_orderkey - o_orderkey % 3)", YEAR_TEXTS)} AS year,
  {pick("o_orderkey", NEWS[:12])} AS summary,
  {pick("o_orderkey", DOCUMENT_KINDS)} AS document_type,
  'https://docs.example/' || CAST(o_orderkey AS STRING) AS document_url
FROM {{orders}}"""

INPUTS["fuel_raw"] = f"""
SELECT CAST(CASE WHEN c_custkey % 10 = 9 THEN c_custkey - 1 ELSE c_custkey END AS STRING) AS epa_id,
  {pick("c_custkey", YEAR_TEXTS)} AS year,
  {pick("c_nationkey", MAKE_TEXTS)} AS make,
  {pick("c_custkey", MODEL_TEXTS)} AS model,
  c_mktsegment AS vehicle_class,
  {pick("c_custkey", ["Regular", "Electricity", "Diesel", "Premium or Electricity"])} AS fuel_type,
  {pick("c_custkey", FUELS)} AS fuel_type1,
  {pick("c_custkey", FUELS2)} AS fuel_type2,
  CAST(c_custkey % 400 AS STRING) AS electric_range,
  {pick("c_custkey", ["0", "110.5", None, "x"])} AS mpge_combined,
  CAST(c_custkey % 37 AS STRING) AS mpg_city,
  CAST(c_custkey % 41 AS STRING) AS mpg_highway,
  CAST(c_custkey % 39 AS STRING) AS mpg_combined,
  CAST(c_custkey % 5 * 2 AS STRING) AS cylinders,
  {pick("c_custkey", ["FWD", "AWD"])} AS drive_type,
  {pick("c_custkey", ["Auto", "Manual", "CVT"])} AS transmission,
  CAST(c_custkey % 11 AS STRING) AS greenhouse_gas_score,
  CAST(c_custkey % 500 AS STRING) AS co2_tailpipe_gpm,
  CAST(c_custkey % 3000 AS STRING) AS annual_fuel_cost
FROM {{customer}}"""

INPUTS["series_raw"] = f"""
SELECT substr(CAST(ts AS STRING), 1, 10) AS date,
  CASE WHEN event_id % 50 = 0 THEN '.' ELSE CAST(value AS STRING) END AS value,
  CASE event_type WHEN 'click' THEN 'TOTALSA' WHEN 'view' THEN 'ALTSALES' WHEN 'error' THEN 'OTHER'
    ELSE 'DAUTOSAAR' END AS series_id
FROM {{events}}"""

INPUTS["articles_raw"] = f"""
SELECT event_id AS article_id, {pick("event_id", NEWS)} AS title,
  'https://news.example/' || CAST(event_id - event_id % 3 AS STRING) AS url, ts AS published_date,
  {pick("event_id", ["wire", "blog"])} AS source, {pick("user_id", ["Ann", None, "Bob"])} AS author,
  {pick("event_id * 7 + user_id", NEWS)} AS summary
FROM {{events}}"""

INPUTS["articles"] = f"""
SELECT event_id AS article_id, {pick("event_id", NEWS)} AS title,
  'https://news.example/' || CAST(event_id AS STRING) AS url, ts AS published_date,
  {pick("event_id", ["wire", "blog"])} AS source, {pick("user_id", ["Ann", None, "Bob"])} AS author,
  {pick("event_id * 7 + user_id", NEWS)} AS summary,
  {pick("event_id", ["recalls", "ev", "sales"])} AS category,
  {pick("event_id + user_id", ["positive", "neutral", "negative", "Neutral", "mixed"])} AS sentiment,
  CASE WHEN event_id % 12 = 11 THEN NULL ELSE event_id % 12 END AS importance_score
FROM {{events}}"""

INPUTS["blurbs"] = f"""
SELECT o_orderkey AS event_id, {pick("o_orderkey", EVENT_TITLES)} AS title,
  'https://events.example/' || CAST(o_orderkey AS STRING) AS url,
  {pick("o_orderkey", EVENT_TITLES)} || {pick("o_orderkey + o_custkey", PLACES)} || ', ' ||
  CASE o_custkey % 6
    WHEN 0 THEN 'Media days ' || {pick("o_custkey", ["Jan.", "February", "Sept.", "Dec", "May", "oct"])} || ' ' ||
      CAST(1 + o_orderkey % 12 AS STRING) || '-' || CAST(13 + o_orderkey % 15 AS STRING) || ', ' ||
      CAST(year(o_orderdate) + 25 AS STRING)
    WHEN 1 THEN {pick("o_orderkey", ["March", "Apr.", "Sept.", "June", "Nov", "Aug"])} || ' ' ||
      CAST(1 + o_orderkey % 31 AS STRING) || ', ' || CAST(year(o_orderdate) + 25 AS STRING)
    WHEN 2 THEN 'early June ' || CAST(year(o_orderdate) + 25 AS STRING)
    WHEN 3 THEN 'date to be announced'
    WHEN 4 THEN 'July 4 - 9 ' || CAST(year(o_orderdate) + 25 AS STRING)
    ELSE 'Press day October ' || CAST(year(o_orderdate) AS STRING) END AS block_text
FROM {{orders}}"""

INPUTS["date_texts"] = f"""
SELECT o_orderkey AS event_id,
  CASE o_custkey % 7
    WHEN 0 THEN 'Media days ' || {pick("o_orderkey", ["Jan.", "February", "Sept.", "Dec", "May", "oct"])} || ' ' ||
      CAST(1 + o_orderkey % 12 AS STRING) || '-' || CAST(13 + o_orderkey % 18 AS STRING) || ', ' ||
      CAST(year(o_orderdate) + 25 AS STRING)
    WHEN 1 THEN '  ' || {pick("o_orderkey", ["March", "Apr.", "Sept.", "June", "Nov", "Aug"])} || ' ' ||
      CAST(1 + o_orderkey % 31 AS STRING) || ', ' || CAST(year(o_orderdate) + 25 AS STRING)
    WHEN 2 THEN 'early June ' || CAST(year(o_orderdate) + 25 AS STRING)
    WHEN 3 THEN 'date to be announced'
    WHEN 4 THEN 'July 4 - 9 ' || CAST(year(o_orderdate) + 25 AS STRING)
    WHEN 5 THEN 'press day October ' || CAST(year(o_orderdate) AS STRING)
    ELSE NULL END AS date_text
FROM {{orders}}"""

INPUTS["trade_events"] = f"""
SELECT o_orderkey AS event_id, {pick("o_orderkey", EVENT_TITLES)} AS title,
  {pick("o_custkey", EVENT_KINDS)} AS event_type, CAST(o_orderdate AS DATE) AS date_start,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS date_end,
  {pick("o_custkey", LOCATIONS)} AS location,
  {pick("o_orderkey + o_custkey", NEWS)} AS description,
  'https://events.example/' || CAST(o_orderkey AS STRING) AS url,
  split({pick("o_custkey", MAKER_LISTS)}, ',') AS participating_manufacturers,
  CAST(o_custkey % 10 AS DOUBLE) / 10 AS relevance_score
FROM {{orders}}"""

INPUTS["questions"] = f"""
SELECT o_orderkey AS question_id, {pick("o_orderkey", QUESTIONS)} AS question,
  {pick("o_custkey", TIER_TEXTS)} AS user_tier
FROM {{orders}}"""

INPUTS["answers"] = f"""
SELECT o_orderkey AS answer_id, {pick("o_orderkey", ANSWERS)} AS answer
FROM {{orders}}"""

INPUTS["sql_log"] = f"""
SELECT event_id AS audit_id, user_id, {pick("event_id + user_id", SQL_TEXTS)} AS sql_text
FROM {{events}}"""

INPUTS["requests"] = f"""
SELECT o_orderkey AS approval_id, o_custkey AS requester_user_id,
  'user' || CAST(o_custkey AS STRING) AS requester_username, {pick("o_custkey", TIER_TEXTS)} AS requester_tier,
  {pick("o_custkey", TIER_TEXTS)} AS user_tier,
  {pick("o_orderkey", QUESTIONS)} AS query_text,
  o_totalprice / 20000 AS estimated_cost, o_orderkey % 1400 * 1000 AS estimated_rows,
  CAST(o_orderkey % 7 AS INT) AS table_count,
  {pick("o_orderkey", ["low", "medium", "high", "low", "low"])} AS risk_level,
  o_orderkey % 9 <> 0 AS approved, CAST(o_orderkey % 4 AS INT) AS warning_count,
  split({pick("o_orderkey", ["none", "uses DROP,slow", "DELETE found,TRUNCATE found", "slow"])}, ',') AS concerns,
  CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'approved' ELSE
    CASE WHEN o_orderkey % 3 = 0 THEN 'pending' ELSE 'rejected' END END AS status,
  CAST(NULL AS BIGINT) AS approver_user_id, CAST(NULL AS STRING) AS approver_username,
  CAST(NULL AS STRING) AS approval_notes, o_orderdate AS created_at, CAST(NULL AS TIMESTAMP) AS reviewed_at
FROM {{orders}}"""

# Facts as the cleaning jobs would leave them, picked directly so that their oracles stay short.
INPUTS["complaint_facts"] = f"""
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING)
    AS complaint_id,
  {pick("l_suppkey % 23", ["Ford", "Tesla", "Kia", "Honda", "Ford", "BMW", "Ford"])} AS make,
  'M' || CAST(l_partkey % 200 AS STRING) AS model, CAST(2015 + l_orderkey % 11 AS INT) AS year,
  'v' || CAST(l_partkey AS STRING) AS vehicle_id,
  l_returnflag = 'A' AS crash_flag,
  {pick("l_orderkey", ["LOW", "MEDIUM", "HIGH", "LOW", "CRITICAL"])} AS severity_level,
  (l_quantity - 25) / 25 AS sentiment_score,
  CASE WHEN l_quantity < 12.5 THEN 'VERY_NEGATIVE' WHEN l_quantity < 20 THEN 'NEGATIVE'
    WHEN l_quantity < 30 THEN 'NEUTRAL' WHEN l_quantity < 37.5 THEN 'POSITIVE' ELSE 'VERY_POSITIVE' END
    AS sentiment_category,
  CAST(l_partkey % 6 AS INT) AS safety_keyword_count
FROM {{lineitem}}"""

INPUTS["rating_facts"] = f"""
SELECT 'rt' || CAST(p_partkey AS STRING) AS rating_id, 'v' || CAST(p_partkey AS STRING) AS vehicle_id,
  {pick("p_partkey", ["FORD", "Tesla", "kia", "Honda", "Mazda"])} AS make, CAST(2015 + p_partkey % 11 AS INT) AS year,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(1 + p_partkey % 5 AS DOUBLE) END AS overall_stars,
  p_size > 25 AS has_advanced_safety
FROM {{part}}"""

INPUTS["recall_facts"] = f"""
SELECT 'R' || CAST(CAST((o_orderkey - o_orderkey % 3) / 3 AS BIGINT) AS STRING) AS recall_id,
  {pick("o_custkey", ["Ford", "Tesla", "Kia", "Honda", "Ford", "Jeep"])} AS make,
  CAST(2013 + o_orderkey % 14 AS INT) AS year, 'v' || CAST(o_orderkey % 2000 AS STRING) AS vehicle_id
FROM {{orders}}"""

INPUTS["investigation_facts"] = f"""
SELECT o_orderkey AS investigation_id, {pick("o_custkey", ["Ford", "Tesla", "Kia"])} AS make,
  {pick("o_orderkey", COMPONENTS)} AS component_name, o_orderkey % 4 = 0 AS has_recall,
  CASE WHEN o_orderstatus = 'O' THEN 'OPEN' ELSE 'CLOSED' END AS investigation_status,
  CAST(o_orderdate AS DATE) AS open_date
FROM {{orders}}"""

INPUTS["fuel_facts"] = f"""
SELECT 'f' || CAST(c_custkey AS STRING) AS fuel_economy_id, 'v' || CAST(c_custkey % 900 AS STRING) AS vehicle_id,
  {pick("c_nationkey", ["Ford", "Tesla", "Kia", "Honda"])} AS make, CAST(2015 + c_custkey % 11 AS INT) AS year,
  CAST(10 + c_custkey % 30 AS INT) AS mpg_combined, c_custkey % 4 = 1 AS is_electric,
  CAST(c_custkey % 500 AS INT) AS electric_range
FROM {{customer}}"""

INPUTS["economic_facts"] = """
SELECT CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS total_vehicle_sales
FROM {orders} GROUP BY CAST(o_orderdate AS DATE)"""
