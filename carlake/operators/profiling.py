"""Column roles, chart data, table documents and vector search."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carlake.functions.derived import any_of
from carlake.operators.reshape import union_all
from carlake.session import new_path

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
TIMES = ("date", "timestamp")


SKETCH_LG = 12  # a sketch counts exactly below 2^12 distinct values
EXACT_DISTINCT = 1 << SKETCH_LG
ROLE_SKETCHES = "position int, column_name string, kind string, rows long, n_values long, sketch binary"


def role_sketches(df: DataFrame) -> DataFrame:
    """What a load adds to the role statistics: one row per column with its counts and a sketch of its distinct values.

    One aggregation without copies of rows. Columns with ID as a word of their name are left out. Rows of several loads
    add up (``merge_sketches``), so a new load does not read old rows."""
    kept = [(i, c, kind) for i, (c, kind) in enumerate(df.dtypes) if "ID" not in c.upper().split("_")]
    if not kept:
        return df.sparkSession.createDataFrame([], ROLE_SKETCHES)

    def sketched(c: str, kind: str) -> Column:
        plain = kind in ("int", "bigint", "float", "double", "string")
        return F.theta_sketch_agg(F.col(c) if plain else F.col(c).cast("string"), SKETCH_LG)

    one = df.agg(
        F.count("*").alias("rows"),
        *[F.count(F.col(c)).alias(f"n{i}") for i, c, _ in kept],
        *[sketched(c, kind).alias(f"s{i}") for i, c, kind in kept],
    )
    entries = [
        F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.lit(kind).alias("kind"), F.col("rows"),
            F.col(f"n{i}").alias("n_values"), F.col(f"s{i}").alias("sketch"),
        )
        for i, c, kind in kept
    ]
    return one.select(F.inline(F.array(*entries)))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """One row per column out of the rows of several loads."""
    return sketches.groupBy("position", "column_name", "kind").agg(
        F.sum("rows").alias("rows"), F.sum("n_values").alias("n_values"), F.theta_union_agg("sketch", F.lit(SKETCH_LG)).alias("sketch")
    )


def roles_of(sketches: DataFrame) -> DataFrame:
    """position, column_name, role, n_distinct and is_exact (false: an estimate, some 2 % off) for merged sketches."""
    counted = sketches.withColumn("n_distinct", F.theta_sketch_estimate("sketch"))
    kind = F.col("kind")
    number = kind.rlike("^(" + "|".join(NUMERIC) + ")")
    time = F.upper("column_name").contains("YEAR") | kind.rlike("^(" + "|".join(TIMES) + ")")
    values = F.col("n_distinct") + F.when(F.col("n_values") < F.col("rows"), 1).otherwise(0)
    quantity = F.when((values <= 10) & (F.col("rows") > 50), "Cat").otherwise("Quant")
    role = F.when(time, "Time").when(number, quantity).otherwise("Cat")
    return counted.where(F.col("n_values") > 0).select(
        "position", F.upper("column_name").alias("column_name"), role.alias("role"), "n_distinct",
        (F.col("n_distinct") < EXACT_DISTINCT).alias("is_exact"),
    )


def column_roles(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row per column: position, role (Time, Quant or Cat), number of distinct values, and whether it is exact.

    All-NULL columns and columns with ID as a word of their name have no role. Numbers with at most ten
    distinct values (NULL is one) count as Cat when there are more than 50 rows.

    One aggregation sketches all columns; counts below EXACT_DISTINCT are exact. Columns with more values are counted
    by a second one, each by itself, or with ``exact=False`` left as estimates and marked so."""
    roles = roles_of(role_sketches(df))
    if not exact:
        return roles
    found = roles.collect()  # one row a column
    names = {r["position"]: df.columns[r["position"]] for r in found if not r["is_exact"]}
    rows = [(r["position"], r["column_name"], r["role"], r["n_distinct"]) for r in found]
    known = df.sparkSession.createDataFrame(rows, "position int, column_name string, role string, n_distinct long")
    if not names:
        return known.withColumn("is_exact", F.lit(True))
    counts = [
        df.select(F.col(f"`{c}`").alias("v")).where("v is not null").distinct().agg(F.lit(i).alias("position"), F.count("*").alias("counted"))
        for i, c in names.items()
    ]
    met = known.join(union_all(*counts), "position", "left")
    return met.select("position", "column_name", "role", F.coalesce("counted", "n_distinct").alias("n_distinct"), F.lit(True).alias("is_exact"))


def pick_chart(roles: DataFrame) -> DataFrame:
    """The chart for a table, from its column roles (a handful of rows): bar, scatter, box or table."""

    def of(role: str, order: Column) -> Column:
        return F.sort_array(
            F.collect_list(F.when(F.col("role") == role, F.struct(order.alias("o"), F.col("position"), F.col("column_name"), F.col("n_distinct"))))
        )

    lists = roles.agg(
        of("Quant", F.lit(0)).alias("q"), of("Cat", -F.col("n_distinct")).alias("most"), of("Cat", F.lit(0)).alias("c")
    )
    q1, q2 = F.get("q", F.lit(0))["column_name"], F.get("q", F.lit(1))["column_name"]
    c1, c2 = F.get("most", F.lit(0)), F.get("c", F.lit(1))["column_name"]
    bar = q1.isNotNull() & c1["n_distinct"].between(5, 20)
    scatter = q1.isNotNull() & q2.isNotNull() & c1.isNotNull()
    box = q1.isNotNull() & c2.isNotNull()
    kind = F.when(bar, "bar").when(scatter, "scatter").when(box, "box").otherwise("table")
    return lists.select(
        kind.alias("chart"),
        F.when(bar | scatter, c1["column_name"]).when(box, c2).alias("category"),
        F.when(bar | scatter | box, q1).alias("measure"),
        F.when(~bar & scatter, q2).alias("second_measure"),
    )


def chart_rows(df: DataFrame, category: str, measure: str) -> DataFrame:
    """Rows of a ranking chart in order of the measure."""
    return df.select(category, measure).orderBy(F.asc(measure), F.asc(category))


SHARES = (0.25, 0.5, 0.75)
FEW = 10_000  # values of a group that are put in order at once


def quartiles(df: DataFrame, group: str, value: str, accuracy: int = 10_000, few: int = FEW) -> DataFrame:
    """Exact quartiles per group with linear interpolation, for groups of any size and values of any spread.

    Selection in rounds: each rank that is looked for has an open interval of values and the number of rows below it. A
    sketch picks two values around the rank; counting what lies below, on and between them says on which of them
    or in which of the three intervals the rank is, whatever the sketch was worth. Rounds go on until every interval holds
    ``few`` rows at most, which then are put in order. So nothing is ever ordered that grows with a group."""
    spark = df.sparkSession
    values = df.filter(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    margin = 5 / accuracy  # the sketch errs by 1 / accuracy
    around = [b for s in SHARES for b in (max(0.0, s - margin), min(1.0, s + margin))]
    stats = values.groupBy("g").agg(
        F.count("*").alias("rows"), F.min("v").alias("least"), F.max("v").alias("most"), F.percentile_approx("v", around, accuracy).alias("s")
    )
    ranks = [(q, f((F.col("rows") - 1) * F.lit(s))) for q, s in enumerate(SHARES) for f in (F.floor, F.ceil)]
    none = F.lit(None).cast("double")
    state = stats.select(
        "g", "rows", "least", "most",
        *[
            F.struct(
                rank.cast("long").alias("rank"), F.lit(0).cast("long").alias("below"), F.col("rows").alias("n"), none.alias("lo"),
                none.alias("hi"), none.alias("found"), F.col("s")[2 * q].alias("a"), F.col("s")[2 * q + 1].alias("b"),
            ).alias(f"t{i}")
            for i, (q, rank) in enumerate(ranks)
        ],
    )
    path = new_path(spark, "quartiles")
    targets = [f"t{i}" for i in range(len(ranks))]
    for turn in count():
        state = _stored(state, f"{path}/{turn}")
        open_above = [F.col(t)["found"].isNull() & (F.col(t)["n"] > few) for t in targets]
        if not state.where(any_of(open_above)).limit(1).count():
            break
        state = _narrowed(values, state, targets, few, turn, f"{path}/{turn}-cut")
    met = values.join(_renamed(state), F.col("g").eqNullSafe(F.col("h")))
    lists = met.groupBy("g").agg(*[F.sort_array(F.collect_list(F.when(_inside(t), F.col("v")))).alias(f"l_{t}") for t in targets])
    done = state.join(lists.withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h")), "left")
    at = [F.coalesce(F.col(t)["found"], F.get(f"l_{t}", (F.col(t)["rank"] - F.col(t)["below"]).cast("int"))) for t in targets]

    def interpolated(q: int) -> Column:
        place = (F.col("rows") - 1) * F.lit(SHARES[q])
        return at[2 * q] + (at[2 * q + 1] - at[2 * q]) * (place - F.floor(place))

    return done.select(
        F.col("g").alias(group), F.col("rows").alias("n"), F.col("least").alias("min"),
        *[interpolated(q).alias(name) for q, name in enumerate(("q1", "median", "q3"))], F.col("most").alias("max"),
    )


def _renamed(state: DataFrame) -> DataFrame:
    return state.withColumnRenamed("g", "h").drop("rows", "least", "most")


def _inside(t: str) -> Column:
    """The row's value lies in the target's interval, and the target is not found yet."""
    lo, hi, v = F.col(t)["lo"], F.col(t)["hi"], F.col("v")
    return F.col(t)["found"].isNull() & (lo.isNull() | (v > lo)) & (hi.isNull() | (v < hi))


def _stored(state: DataFrame, path: str) -> DataFrame:
    """The state as a table: its size is then known, so the values meet it where they lie. A join whose size the planner
    only guesses would send all values of a group to one task and sort them there."""
    state.write.parquet(path)
    return state.sparkSession.read.schema(state.schema).parquet(path)


def _narrowed(values: DataFrame, state: DataFrame, targets: list[str], few: int, turn: int, path: str) -> DataFrame:
    """The state after one round: the interval of each target cut at two values near its rank."""
    same = F.col("g").eqNullSafe(F.col("h"))
    if turn:  # values for the first round come with the counts of the groups
        met = values.join(_renamed(state), same)
        grid = [k / 64 for k in range(65)]
        picked = met.groupBy("g").agg(*[F.percentile_approx(F.when(_inside(t), F.col("v")), grid, 1000).alias(f"s_{t}") for t in targets])
        state = state.join(picked.withColumnRenamed("g", "h"), same, "left").drop("h")

        def cut(t: str) -> Column:
            place = ((F.col(t)["rank"] - F.col(t)["below"]) * 64 / F.col(t)["n"]).cast("int")
            low, high = (F.get(f"s_{t}", p) for p in (F.greatest(place - 1, F.lit(0)), F.least(place + 2, F.lit(64))))
            return F.col(t).withField("a", low).withField("b", high)

        state = _stored(state.withColumns({t: cut(t) for t in targets}).drop(*[f"s_{t}" for t in targets]), path)
    met = values.join(_renamed(state), same)
    v, counts = F.col("v"), []
    for t in targets:
        a, b = F.col(t)["a"], F.col(t)["b"]
        tests = {"below": v < a, "on_a": v == a, "between": (v > a) & (v < b), "on_b": (v == b) & (b > a)}
        counts += [F.count_if(_inside(t) & test).alias(f"{name}_{t}") for name, test in tests.items()]
    counted = state.join(met.groupBy("g").agg(*counts).withColumnRenamed("g", "h"), same)

    def moved(t: str) -> Column:
        c = F.col(t)
        below, on_a, between, on_b = (F.col(f"{name}_{t}") for name in ("below", "on_a", "between", "on_b"))
        rank = c["rank"] - c["below"]
        to_b = below + on_a + between
        into = lambda skipped, n, lo, hi: (
            c.withField("below", c["below"] + skipped).withField("n", n).withField("lo", lo).withField("hi", hi)
        )
        step = (
            F.when(rank < below, into(F.lit(0), below, c["lo"], c["a"]))
            .when(rank < below + on_a, c.withField("found", c["a"]))
            .when(rank < to_b, into(below + on_a, between, c["a"], c["b"]))
            .when(rank < to_b + on_b, c.withField("found", c["b"]))
            .otherwise(into(to_b + on_b, c["n"] - to_b - on_b, c["b"], c["hi"]))
        )
        return F.when(c["found"].isNotNull() | (c["n"] <= few), c).otherwise(step).alias(t)

    return counted.select("g", "rows", "least", "most", *[moved(t) for t in targets])


def schema_docs(catalog: DataFrame) -> DataFrame:
    """One text per table out of catalog rows (one row per column; a table's columns are few)."""
    line = F.concat(
        F.lit("- "), F.col("column_name"), F.lit(" ("), F.col("data_type"), F.lit(")"),
        F.when(~F.col("nullable"), F.lit(" [NOT NULL]")).otherwise(F.lit("")),
        F.when(F.lower("column_name").endswith("_id"), F.lit(" [KEY]")).otherwise(F.lit("")),
    )
    docs = catalog.groupBy("table_name").agg(
        F.first("row_count").alias("row_count"),
        F.count("*").alias("column_count"),
        F.array_sort(F.collect_list(F.struct(F.col("position"), line.alias("line")))).alias("_lines"),
    )
    body = F.array_join(F.transform("_lines", lambda x: x["line"]), "\n")
    text = F.concat(
        F.lit("Table: "), F.col("table_name"), F.lit("\nRow Count: "), F.format_number("row_count", 0),
        F.lit("\nColumns ("), F.col("column_count").cast("string"), F.lit("):\n"), body,
    )
    return docs.select("table_name", "row_count", "column_count", text.alias("content"))


# --- vectors ---------------------------------------------------------------------------


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(_dot(a, b), norm(a) * norm(b))


def vector_topk(
    df: DataFrame, query: DataFrame | Sequence[float], k: int = 3, vector: str = "embedding", tie: str = "vec_id"
) -> DataFrame:
    """The ``k`` rows closest by cosine to one query vector: a list, or a DataFrame of one row and column.

    The query is brought to unit length once, in a scalar subquery. Each partition keeps its own best
    ``k``; nothing else is exchanged."""
    if isinstance(query, DataFrame):
        given = query.select(F.col(query.columns[0]).alias("q"))
    else:
        given = df.sparkSession.range(1).select(F.array(*[F.lit(float(x)) for x in query]).alias("q"))
    length = norm(F.col("q"))
    unit = given.select("q", length.alias("l")).select(F.transform("q", lambda x: x.cast("double") / F.col("l")))
    scored = df.withColumn("_query", unit.scalar())
    scored = scored.withColumn("score", F.try_divide(_dot(F.col(vector), F.col("_query")), norm(F.col(vector))))
    return scored.drop("_query").orderBy(F.desc_nulls_last("score"), F.asc(tie)).limit(k)
