"""Vector search, quartiles and column roles against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from carlake.operators import profiling as M
from carlake.operators import vectors as V
from carlake.session import new_path


def clustered(n=600, width=8, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width)) * 5
    rows = [(i, (centres[i % 12] + rng.normal(size=width) * 0.3).tolist()) for i in range(n)]
    rows += [(n + i, rows[i][1]) for i in range(30)]  # equal vectors
    return [*rows, (9001, None), (9002, [0.0] * width), (9003, [1.0, None] + [0.0] * (width - 2)), (9004, [1.0, 2.0])]


def plain_topk(rows, query, k):
    q = np.array(query)
    scored = []
    for name, v in rows:
        if v and len(v) == len(q) and None not in v and any(v):
            a = np.array(v)
            scored.append((-(a @ q) / np.linalg.norm(a) / np.linalg.norm(q), name))
    scored = sorted((round(s, 9), name) for s, name in scored)
    return [name for _, name in scored[:k]]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(clustered(), "vec_id long, embedding array<double>").repartition(4)


@pytest.mark.parametrize("block", [1024, 3])
def test_topk_of_many_queries(spark, vectors, block):
    rows = clustered()
    asked = [(f"q{i}", rows[i * 7][1]) for i in range(10)] + [("none", None), ("zero", [0.0] * 8), ("short", [1.0, 2.0])]
    queries = spark.createDataFrame(asked, "query_id string, embedding array<double>")
    found = V.vector_topk_many(vectors, queries, 4, block=block).collect()
    for name, q in asked[:10]:
        assert [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == name] == plain_topk(rows, q, 4)
    assert {r.query_id for r in found} == {n for n, _ in asked[:10]} | {"short"}
    assert [r.vec_id for r in found if r.query_id == "short"] == [9004]
    sent = V.best_of_tasks(vectors, queries, 4, "embedding", "vec_id", "query_id", block).count()
    assert sent <= 4 * 11 * 4  # tasks x queries x k
    assert V.vector_topk_many(vectors, queries.limit(0), 4).count() == 0
    assert V.vector_topk_many(vectors.limit(0), queries, 4).count() == 0


def test_pivots_skip_partitions_and_lose_nothing(spark, vectors):
    rows, path = clustered(), new_path(spark, "pivots")
    V.write_pivots(vectors, path, n=12)
    assert spark.read.parquet(f"{path}/rows").count() == len(rows)
    rng, shares = np.random.default_rng(5), []
    for query in [rows[0][1], rows[5][1], rng.normal(size=8).tolist()]:
        top, read = V.pivot_topk(spark, path, query, 5)
        assert [r.vec_id for r in top.collect()] == plain_topk(rows, query, 5)
        shares.append(read["rows_read"] / read["rows"])
    assert min(shares) < 0.5 and read["rows"] == len(rows) - 4
    top, read = V.pivot_topk(spark, path, rows[0][1], 10_000)
    assert top.count() == len(rows) - 4 and read["read"] == read["partitions"]


def test_pivots_of_nothing(spark, vectors):
    path = new_path(spark, "pivots")
    V.write_pivots(vectors.where("embedding is null"), path)
    top, read = V.pivot_topk(spark, path, [1.0, 0.0], 3)
    assert top.count() == 0 and read["rows"] == 0


@pytest.mark.parametrize("few", [1, 20])
def test_quartiles_in_many_rounds(spark, few):
    rng = np.random.default_rng(few)
    groups = {
        "ties": np.repeat([1.0, 2.0, 7.0], [400, 5, 300]), "one": np.array([4.0]), "equal": np.full(500, -3.5),
        "outlier": np.append(rng.normal(size=900), 1e300), "scales": np.array([4096.0**k for k in range(-60, 60)]),
        "signs": rng.permutation(np.arange(-500.0, 501.0)), None: rng.integers(0, 9, 333).astype(float),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("ties", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    found = {r["g"]: r for r in M.quartiles(df, "g", "v", accuracy=20, few=few).collect()}
    assert set(found) == set(groups)
    for g, vs in groups.items():
        want = [*np.quantile(vs, [0.25, 0.5, 0.75]), vs.min(), vs.max(), len(vs)]
        assert [found[g][c] for c in ("q1", "median", "q3", "min", "max", "n")] == pytest.approx(want)
    assert M.quartiles(df.limit(0), "g", "v").count() == 0


def test_no_round_sorts_the_values_of_a_group(spark, monkeypatch):
    plans, real = [], M._narrowed

    def narrowed(*args):
        state = real(*args)
        plans.append(state._jdf.queryExecution().executedPlan().toString())
        return state

    monkeypatch.setattr(M, "_narrowed", narrowed)
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v")).repartition(3)
    rows = {r["g"]: r["median"] for r in M.quartiles(df, "g", "v", accuracy=20, few=1).collect()}
    assert rows == {0: 1499.0, 1: 1500.0} and len(plans) > 1
    # sides of known size are broadcast; a merge would shuffle the values by group and sort them
    assert not any("SortMergeJoin" in plan for plan in plans), plans


def test_a_sketch_that_is_wrong_costs_rounds_only(spark, monkeypatch):
    real = F.percentile_approx
    monkeypatch.setattr(M.F, "percentile_approx", lambda c, shares, accuracy: F.transform(real(c, shares, accuracy), lambda x: x * 0 + 10))
    df = spark.range(101).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
    row = M.quartiles(df, "g", "v", few=95).first()
    assert (row["q1"], row["median"], row["q3"]) == (25.0, 50.0, 75.0)


def test_sketches_of_loads_add_up(spark):
    df = spark.range(20_000).select(
        F.col("id").alias("row_id"), F.col("id").alias("many"), (F.col("id") % 7).alias("few"), F.lit(None).cast("int").alias("nothing"),
        (F.col("id") % 3000).cast("string").alias("name"), F.to_date(F.lit("2024-01-01")).alias("day"), (F.col("id") % 2 == 0).alias("flag"),
        (F.col("id") % 11).cast("decimal(9,2)").alias("price"), F.when(F.col("id") % 2 == 0, 1.0).alias("model_year"),
    )
    loads = [M.role_sketches(df.where(F.col("id") % 3 == k)) for k in range(3)]
    merged = M.roles_of(M.merge_sketches(loads[0].union(loads[1]).union(loads[2])))
    found = {r.column_name: (r.role, r.n_distinct if r.is_exact else None, r.is_exact) for r in merged.collect()}
    assert found == {
        "MANY": ("Quant", None, False), "FEW": ("Cat", 7, True), "NAME": ("Cat", 3000, True), "DAY": ("Time", 1, True),
        "FLAG": ("Cat", 2, True), "PRICE": ("Quant", 11, True), "MODEL_YEAR": ("Time", 1, True),
    }
    exact = {r.column_name: (r.n_distinct, r.is_exact) for r in M.column_roles(df).collect()}
    assert exact["MANY"] == (20_000, True) and exact["NAME"] == (3000, True)
    estimate = next(r for r in merged.collect() if r.column_name == "MANY").n_distinct
    assert abs(estimate - 20_000) < 2000
    assert "Expand" not in M.role_sketches(df)._jdf.queryExecution().executedPlan().toString()
    assert M.column_roles(df.limit(0)).count() == 0
