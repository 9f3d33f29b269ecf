"""Properties of the operators, skew and plan shape."""

from datetime import date, datetime

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carlake.functions import cleaning as C
from carlake.functions import text as T
from carlake.operators import aggregates as A
from carlake.operators import filters as O
from carlake.operators import joins as J
from carlake.operators import profiling as M
from carlake.operators import reshape as R
from carlake.operators import upsert as U
from carlake.plans import facts
from carlake.session import new_path, shared_dir, spread
from carlake.sources import sinks

AS_OF = datetime(2026, 1, 1)


def make_scorecard_joined_first(
    recalls: DataFrame, ratings: DataFrame, complaints: DataFrame, lo: int = 2015, hi: int = 2025
) -> DataFrame:
    """The same answer by joining the rows themselves. Only for checking on small data."""
    r, s, c = recalls.alias("r"), ratings.alias("s"), complaints.alias("c")
    return (
        r.filter(F.col("r.year").between(lo, hi))
        .join(s, F.upper("r.make") == F.upper("s.make"), "left")
        .join(c, F.upper("r.make") == F.upper("c.make"), "left")
        .groupBy(F.col("r.make").alias("make"))
        .agg(
            F.count_distinct("r.recall_id").alias("recall_count"),
            F.avg("s.overall_stars").alias("avg_rating"),
            F.avg("c.sentiment_score").alias("avg_sentiment"),
            F.count_distinct("c.complaint_id").alias("complaint_count"),
        )
        .filter(F.col("recall_count") > 0)
    )


def plan(df):
    return df._jdf.queryExecution().toString()


def test_dedup_is_unique_total_and_keeps_one_null_key(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), (1, 5), (1, 4), (2, 9)], "k int, v int")
    got = sorted((r["k"] or 0, r["v"]) for r in R.dedup(df, ["k"]).collect())
    assert got == [(0, 1), (1, 4), (2, 9)]
    assert R.dedup(R.dedup(df, ["k"]), ["k"]).count() == 3


def test_dedup_reduces_before_the_shuffle(spark):
    text = plan(R.dedup(spark.range(100).selectExpr("id % 3 AS k", "id AS v"), ["k"]))
    assert "partial_min" in text


def test_cleaning_is_idempotent(spark):
    df = spark.createDataFrame([(" <b>x</b>  y ",), ("Tesla Motors",), ("",), (None,)], "t string")
    for fn in (C.clean_text, C.standardize_name, C.norm_label):
        assert df.select(fn(fn(F.col("t")))).collect() == df.select(fn(F.col("t"))).collect()


def test_scorecard_equals_the_plain_join(spark):
    recalls = spark.range(12).selectExpr(
        "concat('r', id % 5) AS recall_id", "element_at(array('Ford','Kia','ford'), cast(id % 3 + 1 AS int)) AS make",
        "cast(2014 + id AS int) AS year",
    )
    ratings = spark.range(7).selectExpr("if(id % 2 = 0, 'FORD', 'Kia') AS make", "cast(id % 5 AS double) AS overall_stars")
    complaints = spark.range(9).selectExpr(
        "if(id % 3 = 0, 'Ford', 'Audi') AS make", "cast(id AS double) / 10 AS sentiment_score", "id AS complaint_id"
    )

    def rounded(df):
        return sorted(
            (r["make"], r["recall_count"], r["avg_rating"] and round(r["avg_rating"], 9), r["avg_sentiment"] and round(r["avg_sentiment"], 9), r["complaint_count"])
            for r in df.collect()
        )

    assert rounded(J.make_scorecard(recalls, ratings, complaints)) == rounded(
        make_scorecard_joined_first(recalls, ratings, complaints)
    )


def test_inner_count_equals_the_join(spark):
    a = spark.range(50).selectExpr("id % 3 AS k")
    b = spark.range(20).selectExpr("id % 4 AS k")
    want = sorted(tuple(r) for r in a.join(b, "k").groupBy("k").count().collect())
    assert sorted(tuple(r) for r in J.inner_count(a, b, "k").collect()) == want


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_the_plain_one(spark, how):
    a = spark.range(200).selectExpr("if(id % 3 = 0, 0, id % 17) AS k", "id AS v")
    b = spark.range(10).selectExpr("id AS k", "id * 2 AS w")
    plain = sorted(str(tuple(r)) for r in J.join_vehicle(a, b, "k", how).collect())
    assert sorted(str(tuple(r)) for r in J.join_vehicle(a, b, "k", how, salts=5).collect()) == plain


def test_a_salted_side_is_not_broadcast(spark):
    """The planner does not see that a side was repeated, so it would send all copies through the driver."""
    a, b = spark.range(200).selectExpr("id % 17 AS k", "id AS v"), spark.range(10).selectExpr("id AS k")
    joined = J.join_vehicle(a, b, "k", salts=5)
    assert joined.count() == 120
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_no_side_is_hinted(spark):
    """An exploded side looks small to the planner and is not; only measured sizes may decide."""
    few = spark.range(1000).selectExpr("id", "explode(sequence(0, 99)) AS v").selectExpr("id * 100 + v AS id")
    logical = J.join_vehicle(spark.range(5), few, "id")._jdf.queryExecution().analyzed().toString()
    assert "hint" not in logical.lower()


def test_spread_is_the_callers_choice(spark):
    df = spark.range(100).coalesce(1)
    assert spread(df, None) is df
    assert spread(df, 4).rdd.getNumPartitions() == 4


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def __init__(self, values):
            self.get = lambda key, default=None: values.get(key, default)

    class Session:
        def __init__(self, **values):
            self.conf = Conf({k.replace("_", "."): v for k, v in values.items()})

    with pytest.raises(RuntimeError):
        shared_dir(Session(spark_master="spark://host:7077"))
    assert shared_dir(Session(spark_master="yarn", spark_checkpoint_dir="hdfs://x/y/")) == "hdfs://x/y"
    assert shared_dir(Session(spark_master="local[4]"))


def test_pivot_keeps_the_maximum_per_cell(spark):
    df = spark.createDataFrame([("d1", "a", 1.0), ("d1", "a", 3.0), ("d1", "b", 2.0), ("d2", "c", 9.0)], "d string, n string, v double")
    got = {r["d"]: (r["A"], r["B"]) for r in R.pivot_series(df, "d", "n", "v", {"a": "A", "b": "B"}).collect()}
    assert got == {"d1": (3.0, 2.0), "d2": (None, None)}


def article(url, title, source, author, seq):
    return (url, title, source, author, seq)


def test_upsert_twice_is_upsert_once_and_keeps_the_author(spark):
    ddl = "url string, title string, source string, author string"
    target = spark.createDataFrame([("u1", "old", "s0", "a0")], ddl)
    batch = spark.createDataFrame(
        [article("u1", "new", "s1", "a1", 1), article("u2", "first", "s2", "a2", 2), article("u2", "last", "s3", "a3", 3)],
        ddl + ", seq int",
    )
    once = U.upsert_articles(target, batch, "seq")
    want = [("u1", "new", "s0", "a0"), ("u2", "last", "s2", "a2")]
    assert sorted(tuple(r) for r in once.collect()) == want
    assert sorted(tuple(r) for r in U.upsert_articles(once, batch, "seq").collect()) == want


def test_null_keys_match_only_null_safe(spark):
    target = spark.createDataFrame([("t", None, 1)], "title string, date_start date, n int")
    batch = spark.createDataFrame([("t", None, 2, 1), ("t", None, 3, 2)], "title string, date_start date, n int, seq int")
    assert [tuple(r) for r in U.upsert_events(target, batch, "seq").collect()] == [("t", None, 3)]
    loose = U.upsert(target, batch, ["title", "date_start"], "seq")
    assert sorted(r["n"] for r in loose.collect()) == [1, 2, 3]


def test_snapshots_replay(spark):
    root = new_path(spark, "snap")
    U.write_snapshot(spark.range(3), root, 1)
    U.write_snapshot(spark.range(5), root, 2)
    U.write_snapshot(spark.range(4), root, 2)
    assert U.latest_version(spark, root) == 2
    assert U.read_snapshot(spark, root).count() == 4
    assert U.read_snapshot(spark, root, before=2).count() == 3
    assert U.read_snapshot(spark, root + "-none") is None


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 100, 1001])
def test_quartiles_are_exact(spark, n):
    import numpy as np

    rng = np.random.default_rng(n)
    values = [float(v) for v in np.concatenate([rng.normal(size=n), np.full(n, 2.5)])]
    df = spark.createDataFrame([("g", v) for v in values] + [(None, 1.0)], "g string, v double")
    rows = {r["g"]: r for r in M.quartiles(df, "g", "v", accuracy=100).collect()}
    want = np.quantile(values, [0.25, 0.5, 0.75])
    assert [rows["g"][c] for c in ("q1", "median", "q3")] == pytest.approx(list(want))
    assert rows[None]["median"] == 1.0


def test_quartiles_of_a_skewed_range_order_few_rows(spark):
    df = spark.range(100_000).select(F.lit("g").alias("g"), F.when(F.col("id") == 0, 1e12).otherwise(F.col("id")).alias("v"))
    row = M.quartiles(df, "g", "v").first()
    assert [row[c] for c in ("q1", "median", "q3", "max")] == [25000.75, 50000.5, 75000.25, 1e12]


def test_null_keys_pass_beside_the_join(spark):
    ddl = "url string, title string, source string, author string"
    target = spark.createDataFrame([(None, "old", "s", "a"), ("u", "old", "s", "a")], ddl)
    batch = spark.createDataFrame([article(None, "new", "s1", "a1", 1), article("u", "new", "s1", "a1", 2)], ddl + ", seq int")
    rows = [tuple(r) for r in U.upsert_articles(target, batch, "seq").collect()]
    assert sorted(rows, key=str) == sorted([(None, "old", "s", "a"), (None, "new", "s1", "a1"), ("u", "new", "s", "a")], key=str)


def test_capped_marks_a_cut_result(spark):
    df = spark.range(5)
    assert {r["truncated"] for r in A.capped(df, [F.asc("id")], 5).collect()} == {False}
    cut = A.capped(df, [F.asc("id")], 4).collect()
    assert len(cut) == 4 and {r["truncated"] for r in cut} == {True}


def test_year_window_counts_the_rest(spark):
    from pyspark.sql import Observation

    seen = Observation()
    df = spark.createDataFrame([(2019,), (2020,), (None,)], "y int")
    assert O.filter_year_window(df, "y", 2020, 2025, seen).collect()[0]["y"] == 2020
    assert seen.get["invalid_years"] == 2


def test_filters_reach_the_scan(spark):
    path = new_path(spark, "news")
    spark.range(10).selectExpr(
        "id AS article_id", "'t' AS title", "'s' AS summary", "timestamp_ntz'2024-01-01 00:00:00' AS published_date", "'x' AS body"
    ).write.parquet(path)
    from carlake.operators.search import breaking

    text = plan(breaking(spark.read.parquet(path), datetime(2024, 1, 2)).select("article_id"))
    assert "GreaterThanOrEqual(published_date" in text
    assert "body" not in text.split("== Physical Plan ==")[1].split("ReadSchema")[1]


def test_top_k_limits_ranks_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 AS k", "id AS v")
    text = plan(A.top_k_per(df, ["k"], [F.desc("v")], 2))
    assert "WindowGroupLimit" in text


def test_run_needs_two_jobs(spark):
    rows = [(str(i % 40), "Ford", "2021", f"text {i}") for i in range(100)] + [("900", "Rivian", "2021", "x")]
    raw = spark.createDataFrame(rows, "CMPLID string, MAKETXT string, YEARTXT string, CDESCR string")
    raw = raw.withColumn("MFR_NAME", F.lit(None).cast("string")).withColumn("MODELTXT", F.lit("m"))
    path = new_path(spark, "lake") + "/parquet/complaints"
    got = facts.run(raw, lambda df: facts.clean_complaints(df, AS_OF, embedding_dim=16), path)
    assert got == {"initial_rows": 101, "final_rows": 40, "removed_rows": 61, "retention_pct": 39.6}
    table = spark.read.parquet(path)
    assert len(table.columns) == 35 and table.count() == 40
    csv = spark.read.option("header", True).csv(path.replace("/parquet/", "/csv/"))
    assert csv.count() == 40 and csv.first()["complaint_embedding"].startswith("[")


def test_guarded_overwrite(spark):
    with pytest.raises(ValueError):
        sinks.safe_overwrite(spark.range(1), new_path(spark, "raw"))


def test_embedding_has_unit_length(spark):
    df = spark.createDataFrame([("brakes failed twice",), (None,)], "t string")
    rows = T.embed_text(df, "t", 64).collect()
    assert sum(x * x for x in rows[0]["embedding"]) == pytest.approx(1.0, abs=1e-6)
    assert sum(rows[1]["embedding"]) == pytest.approx(sum(rows[1]["embedding"])) and len(rows[1]["embedding"]) == 64


def test_vector_search_takes_a_list(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id int, embedding array<float>")
    assert [r["vec_id"] for r in M.vector_topk(df, [1.0, 0.1], 2).collect()] == [1, 3]


def test_embedding_counts_hashed_words(spark):
    from hashlib import md5

    import numpy as np

    texts = ["ford recall ford", "brake", "a b c d e f g h i j k l m n o p", "\u00c9t\u00e9  \u00e9T\u00c9\n\tstra\u00dfe"]
    rows = T.embed_text(spark.createDataFrame([(x,) for x in texts], "text string"), "text", 64).collect()
    for row in rows:
        want = np.zeros(64)
        for word in row["text"].lower().split():
            want[int(md5(word.encode()).hexdigest()[:8], 16) % 64] += 1
        assert row["embedding"] == pytest.approx(list(want / np.linalg.norm(want)), abs=1e-6)
    blank = T.embed_text(spark.createDataFrame([(None,), (" \n",)], "text string"), "text", 8).collect()
    assert [row["embedding"] for row in blank] == [[0.0] * 8] * 2


def test_embedding_digest_takes_whole_vectors(spark):
    """The digest is made of blocks of rows; place by place through a lambda it was most of the time of the complaint facts."""
    from checks.tagging import embedding_digest

    given = [([0.0, 0.6, 0.0, 0.8],), (None,), ([0.0, 0.0],), ([],), ([1.0],)]
    df = spark.createDataFrame(given, "v array<float>").coalesce(1).select(embedding_digest("v").alias("d"))
    assert [r["d"] for r in df.collect()] == ["1:600000,3:800000", None, "", "", "0:1000000"]
    assert "lambda" not in df._jdf.queryExecution().executedPlan().toString()


def test_embedding_is_made_in_one_step_with_its_digest(spark):
    """The vectors of a digest never come back to the JVM: one evaluation by Arrow, and no vector type between."""
    from checks.tagging import embedding_digest

    words = [" ".join(f"w{i}" for i in range(n % 300)) for n in range(300)]
    df = spark.createDataFrame([(w,) for w in words], "text string").coalesce(1)
    made = T.embed_text(df, "text", 32, "v")
    plan = made.withColumn("v", embedding_digest("v"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "lambda" not in plan
    # more rows than one block of words
    lengths = [sum(x * x for x in r["v"]) for r in made.collect()]
    assert lengths == pytest.approx([0.0 if w == "" else 1.0 for w in words], abs=1e-5)


def test_dates_are_counted_and_not_parsed(spark):
    """No parser that throws for each day that is missing in its month."""
    days = ["20230229", "20240229", "19000229", "20000229", "20230431", "20231231", "00000101", "2023123", "20231301", None]
    want = [None, date(2024, 2, 29), None, date(2000, 2, 29), None, date(2023, 12, 31), "year 0", None, None, None]
    df = spark.createDataFrame([(d,) for d in days], "d string").select("d", C.parse_yyyymmdd(F.col("d")).alias("x"))
    got = {r["d"]: r["x"] for r in df.where("d <> '00000101' OR d IS NULL").collect()}
    assert got == {d: w for d, w in zip(days, want) if w != "year 0"}
    assert df.where("d = '00000101' AND x = DATE'0000-01-01'").count() == 1
    assert "gettimestamp" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
    numbers = ["x", "abc", "", " 12 ", "1e3", "NaN", "-inf", "N/A", "5d", None]
    df = spark.createDataFrame([(n,) for n in numbers], "n string")
    assert df.where(~C._to_double(F.col("n")).eqNullSafe(F.col("n").try_cast("double"))).count() == 0


def test_quick_patterns_find_the_same(spark):
    """Patterns with their quick beginnings, against the patterns as they stand, in texts with odd letters and boundaries."""
    from carlake import rules

    texts = [
        "Media days Sept. 12-15, 2026", "xMay 3, 2024 or June 4 - 9 2027", "étéJan. 1-2, 2030", "Maí 5 2024", "\U0001d400bc 7, 2025",
        "abc.  1 2, 2020", "_May_ 1,2021", "GM's new Model 3, X5 and F-150A", "ÉF-1 aBC-2 ́GM GḾ AB", "ModelModel Model 7 s2024 2024 20245 ٣2024",
        "Volvo Motors said  Kia will", "", "ſUV EV's car", None,
    ]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    for p in [*rules.MODEL_PATTERNS, rules.MAKER_COMPANY, rules.MAKER_VERB, rules.MAKER_OWNER, rules.MAKER_ACRONYM,
              rules.DATE_RANGE, rules.DATE_SINGLE, rules.DATE_YEAR]:
        assert T.quick(p) != p

        def found(pattern):
            return F.regexp_extract_all("t", F.lit(T.UNICODE + pattern), F.lit(1))

        assert df.where(~found(T.quick(p)).eqNullSafe(found(p))).count() == 0, p


def test_dates_behind_a_long_word_cost_one_pass(spark):
    """A word of n letters was tried from each of its letters; the time grew with n x n."""
    from time import perf_counter

    df = spark.createDataFrame([("a" * 200_000 + "- June 3, 2024",)], "t string")
    start = perf_counter()
    assert T.with_event_dates(df, "t").first()["date_start"] == date(2024, 6, 3)
    assert perf_counter() - start < 15
