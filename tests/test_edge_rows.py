"""Edge rows of the cleaning, derived and text expressions."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from carlake import rules
from carlake.functions import cleaning as C
from carlake.functions import derived as D
from carlake.functions import text as T
from carlake.operators import governance as G
from carlake.operators import search as Q


@pytest.mark.parametrize(
    "given, want",
    [(" tesla, inc. ", "Tesla"), ("GM", "GMC"), ("FCA US, LLC", "Jeep"), ("Rivian", "Rivian"), (None, None), ("tesla\t", "tesla\t")],
)
def test_standardize_name(one, given, want):
    assert one(C.standardize_name, given) == want


@pytest.mark.parametrize(
    "given, want",
    [("9999", None), ("1989", None), ("2031", None), ("x", None), ("2020", 2020), ("2022.0", 2022), (None, None), ("1990", 1990)],
)
def test_clean_year(one, given, want):
    assert one(C.clean_year, given) == want


@pytest.mark.parametrize(
    "given, want",
    [
        ("20240229", date(2024, 2, 29)), ("20230229", None), ("00000000", None), ("99999999", None), ("", None), (" ", None),
        ("2024011", None), ("19891231", None), (None, None), ("abcdefgh", None),
    ],
)
def test_clean_date(one, given, want):
    assert one(C.clean_date, given) == want


def test_plain_date_has_no_lowest_year(one):
    assert one(C.parse_yyyymmdd, "19891231") == date(1989, 12, 31)


@pytest.mark.parametrize(
    "given, want",
    [("<b>a</b>  b\t", "a b"), ("<p></p>", None), ("itâ€™s", "it's"), (None, None), ("a â€\" b", "a - b"), ("oÃ¯Â¬ce", "ofice")],
)
def test_clean_text(one, given, want):
    assert one(C.clean_text, given) == want


@pytest.mark.parametrize("given, want", [(" y ", True), ("N", False), ("U", None), (None, None)])
def test_yn(one, given, want):
    assert one(C.yn_to_bool, given) is want


@pytest.mark.parametrize("given, want", [(None, 0), ("3", 3), ("x", None)])
def test_null_to_zero(one, given, want):
    assert one(C.null_to_zero_int, given) == want


@pytest.mark.parametrize("given, want", [("-1", None), ("500001", None), ("abc", None), ("500000", 500000.0), ("0", 0.0)])
def test_clamp(one, given, want):
    assert one(lambda c: C.clamp_null(c, 0, 500000), given) == want


@pytest.mark.parametrize(
    "given, want", [("Not Rated", None), ("-", None), ("", None), ("0", None), ("6", None), (None, None), ("4", 4.0), ("n/a", None)]
)
def test_star(one, given, want):
    assert one(C.clean_star, given) == want


@pytest.mark.parametrize("given, want", [("Standard", True), ("optional", True), ("YES", True), ("No", False), (None, False)])
def test_feature(one, given, want):
    assert one(C.feature_flag, given) is want


@pytest.mark.parametrize(
    "given, want",
    [
        ((1, 0, False, False), "CRITICAL"), ((0, 2, None, None), "HIGH"), ((0, 0, None, True), "MEDIUM"),
        ((None, None, None, None), "LOW"),
    ],
)
def test_severity(one, given, want):
    assert one(D.severity, *given, kinds=["int", "int", "boolean", "boolean"]) == want


@pytest.mark.parametrize(
    "given, want",
    [("FUEL SYSTEM, BRAKE LINE", "BRAKING_SYSTEM"), ("AIR BAGS", "RESTRAINT_SYSTEM"), ("VISIBILITY", "OTHER"), (None, "OTHER")],
)
def test_component(one, given, want):
    assert one(D.categorize, given) == want


@pytest.mark.parametrize(
    "opened, close, days, long",
    [
        ("2020-01-01", "2021-01-01", 366, True), ("2021-01-01", "2022-01-01", 365, False), ("2020-01-01", None, None, False),
    ],
)
def test_duration(one, opened, close, days, long):
    assert one(D.duration_days, opened, close, kinds=["date", "date"]) == days
    assert one(lambda a, b: D.is_long(D.duration_days(a, b)), opened, close, kinds=["date", "date"]) is long


@pytest.mark.parametrize(
    "given, want",
    [
        (("Electricity", None), "Electric"), (("Premium Gasoline", "Electricity"), "Plug-in Hybrid"),
        (("Regular Gasoline", "E85"), "Flex-Fuel"), ((None, None), "Other"), (("Diesel", None), "Diesel"),
    ],
)
def test_fuel_category(one, given, want):
    assert one(D.fuel_category, *given) == want


@pytest.mark.parametrize(
    "given, mean, tier",
    [((5, None, 4), 4.5, "EXCELLENT"), ((None, None, None), None, "NOT_RATED"), ((1, 2, None), 1.5, "POOR")],
)
def test_row_mean_and_tier(one, given, mean, tier):
    kinds = ["double"] * 3
    assert one(lambda *c: D.row_mean(c), *given, kinds=kinds) == mean
    assert one(lambda *c: D.safety_tier(D.row_mean(c)), *given, kinds=kinds) == tier


@pytest.mark.parametrize(
    "given, want",
    [
        (-0.51, "VERY_NEGATIVE"), (-0.5, "NEGATIVE"), (-0.2, "NEUTRAL"), (0.2, "POSITIVE"), (0.5, "VERY_POSITIVE"), (None, None),
    ],
)
def test_sentiment_band(one, given, want):
    assert one(D.sentiment_band, given, kinds=["double"]) == want


def test_surrogate_key(one):
    want = "fb68be3e7983f36a77d97bb8c8f663dbc2987bd53121c29fe52da3e9c6cff694"
    assert one(lambda *c: D.surrogate_key(c), "Ford", None, 2020, kinds=["string", "string", "int"]) == want


# --- text ----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "given, want",
    [
        ("Ford recalls trucks after fire reports", "recalls"), ("Honda CEO steps down", "executive"),
        ("Quarterly results lift shares", "financial"), ("New battery plant opens", "ev"), ("Units sold fall", "sales"),
        ("Supplier halts assembly", "manufacturing"), ("Software update adds connected features", "technology"),
        ("A quiet week", "general"), ("Recall hits electric vehicle sales", "recalls"),
    ],
)
def test_news_category(one, given, want):
    assert one(lambda c: T.news_category(F.lower(c)), given) == want


@pytest.mark.parametrize(
    "given, want",
    [("new launch delay", "neutral"), ("growth in a strong year", "positive"), ("a recall", "negative"), ("nothing", "neutral")],
)
def test_news_sentiment(one, given, want):
    assert one(lambda c: T.news_sentiment(F.lower(c)), given) == want


def test_importance_is_capped(one):
    def score(c):
        low = F.lower(c)
        return T.importance(low, T.news_category(low), T.is_breaking(low))

    assert one(score, "Breaking exclusive: bankruptcy and recall") == 10
    assert one(score, "A quiet week") == 5


def test_entities(one):
    text = "Tesla announced the Model 3 in Austin, TX"
    assert one(T.extract_makers, text) == ["Tesla"]
    assert one(T.extract_models, text) == ["Model 3"]
    assert one(T.extract_places, text) == ["Austin, TX"]
    assert one(T.extract_makers, "GM, VW and BYD electric vehicle sales") == ["BYD", "GM", "VW"]
    assert one(T.extract_makers, "GM, VW and BYD met") == []
    assert "Jane Smith" in one(T.extract_people, "Jane Smith, CEO, said F-150 output rose")
    assert one(T.extract_models, "Jane Smith, CEO, said F-150 output rose") == ["F-150"]
    assert one(T.extract_models, "a self-driving e-tron") == ["e-tron"]


def test_sentence_filter(spark):
    df = spark.createDataFrame([("Sales rose 5. Prices will likely fall. Typically costs more.",), ("",)], "a string")
    rows = {r["a"]: r for r in T.with_sentences_dropped(df, "a").collect()}
    first = rows["Sales rose 5. Prices will likely fall. Typically costs more."]
    assert first["clean_text"] == "Sales rose 5."
    assert first["removed"] == ["Prices will likely fall", "Typically costs more"]
    assert rows[""]["clean_text"] == ""


def test_list_items_are_kept_whole_or_not_at_all(spark):
    df = spark.createDataFrame([(["One fact", "It is likely. Sure", " ", "Two. Three."],)], "a array<string>")
    assert df.select(T.keep_items(F.col("a")).alias("x")).first()["x"] == ["One fact.", "Two. Three."]


@pytest.mark.parametrize(
    "text, score, label, negations, safety",
    [
        ("The brakes did not fail and never leaked.", 1 / 3, "positive", 2, 3),
        # "brake" is two words after "not", so its sign changes: p = 1, n = 1 + 1 + 3 + 3
        ("airbag did not deploy, brake failure, crash and fire", -7 / 9, "negative", 1, 5),
        ("A quiet week", 0.0, "neutral", 0, 0),
        (None, None, None, None, None),
    ],
)
def test_complaint_sentiment(spark, text, score, label, negations, safety):
    row = T.with_sentiment(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert row["sentiment_score"] == (score if score is None else pytest.approx(score))
    assert row["sentiment_label"] == label
    if text is not None:
        assert (row["negation_count"], row["safety_keyword_count"]) == (negations, safety)


def test_safety_lexicon_is_large_enough():
    assert len(set(rules.SAFETY_WORDS)) >= 30


# --- governance, response shape ---------------------------------------------------------------


def test_column_rules():
    assert G.may_read("manager", "NHTSA.FACT_COMPLAINTS", "complaint_description")
    assert not G.may_read("manager", "FACT_COMPLAINTS", "VIN")
    assert not G.may_read("analyst", "FACT_COMPLAINTS", "mileage")
    assert G.may_read("analyst", "FACT_RATINGS", "anything")
    assert not G.may_read("analyst", "OTHER", "x")
    assert G.may_read("manager", "FACT_INVESTIGATIONS", "summary")
    assert G.may_read("executive", "FACT_COMPLAINTS", "vin")


def test_approval_limits(spark):
    rows = [
        ("analyst", 5.00), ("analyst", 5.01), ("executive", 999.0), ("guest", 5.01), ("manager", 5.01),
    ]
    df = spark.createDataFrame(rows, "user_tier string, estimated_cost double").selectExpr(
        "*", "10L AS estimated_rows", "1 AS table_count", "'low' AS risk_level", "true AS approved",
        "cast(array() as array<string>) AS concerns",
    )
    got = [(r["user_tier"], r["estimated_cost"], r["approval_needed"]) for r in G.approval_needed(df).collect()]
    assert got == [
        ("analyst", 5.0, False), ("analyst", 5.01, True), ("executive", 999.0, False), ("guest", 5.01, True),
        ("manager", 5.01, False),
    ]


@pytest.mark.parametrize("value", [5.01, 8.065, 21.715, 7.125, 7.375, 5.995, 1234.5, 100.0, 6.999999, 19.994999999])
def test_costs_are_rounded_by_their_exact_value(one, value):
    assert one(G.two_decimals, value, kinds=["double"]) == f"{value:.2f}"


def test_zero_score_reads_as_absent(spark):
    df = spark.createDataFrame([(1, 0, datetime(2024, 1, 2, 3, 4, 5)), (2, 7, datetime(2024, 1, 2, 3, 4, 5, 600000))],
                               "article_id int, importance_score int, published_date timestamp_ntz")
    rows = Q.format_rows(df).orderBy("article_id").collect()
    assert [(r[1], r[2]) for r in rows] == [(None, "2024-01-02T03:04:05"), (7.0, "2024-01-02T03:04:05.600000")]


def test_search_limits_are_checked(spark):
    df = spark.createDataFrame([], "article_id int, title string, summary string, published_date timestamp_ntz")
    with pytest.raises(ValueError):
        Q.breaking(df, datetime(2024, 1, 1), hours=169)
    with pytest.raises(ValueError):
        Q.news_by_maker(df, datetime(2024, 1, 1), "Ford", limit=101)
