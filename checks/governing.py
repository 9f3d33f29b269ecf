"""G operators (access, screens, approvals) and M operators (profiles, charts, vectors)."""

from __future__ import annotations

from pyspark.sql import functions as F

from carlake import rules
from carlake.operators import governance as G
from carlake.operators import profiling as M
from carlake.operators import vectors as V
from carlake.operators.upsert import upsert_texts
from carlake.session import new_path
from carlake.sources.catalog import catalog_profile
from checks.inputs import text
from checks.registry import query


@query(
    "G01_analyst_complaints",
    """SELECT complaint_id, make, model, year, crash_flag, severity_level, sentiment_score, sentiment_category, safety_keyword_count
    FROM {complaint_facts}""",
)
def _(t):
    return G.project_for_tier(t("complaint_facts"), "NHTSA.FACT_COMPLAINTS", "analyst")


@query(
    "G01_manager_complaints",
    "SELECT complaint_id, make, 'd' || complaint_id AS complaint_description FROM {complaint_facts}",
)
def _(t):
    df = t("complaint_facts").select(
        "complaint_id", "make", F.concat(F.lit("d"), "complaint_id").alias("complaint_description"),
        F.lit("x").alias("vin"), F.lit("x").alias("complaint_embedding"),
    )
    return G.project_for_tier(df, "FACT_COMPLAINTS", "manager")


COMPLAINT_COLUMNS = {  # column -> (analyst, manager)
    "complaint_id": (1, 1), "make": (1, 1), "model": (1, 1), "year": (1, 1), "vehicle_id": (0, 0), "crash_flag": (1, 1),
    "severity_level": (1, 1), "sentiment_score": (1, 1), "sentiment_category": (1, 1), "safety_keyword_count": (1, 1),
}
RATING_COLUMNS = {c: (1, 1) for c in ("rating_id", "vehicle_id", "make", "year", "overall_stars", "has_advanced_safety")}
OTHER_COLUMNS = {c: (0, 0) for c in ("r_regionkey", "r_name")}
MATRIX = ", ".join(
    f"('{table}', '{column}', '{tier}', {allowed})"
    for table, columns in (
        ("NHTSA.FACT_COMPLAINTS", COMPLAINT_COLUMNS), ("FACT_RATINGS", RATING_COLUMNS), ("REGION", OTHER_COLUMNS)
    )
    for column, (analyst, manager) in columns.items()
    for tier, allowed in (("analyst", bool(analyst)), ("manager", bool(manager)), ("executive", True))
)


@query(
    "G02_access_matrix",
    f"""SELECT m.*, CASE m.table_name WHEN 'NHTSA.FACT_COMPLAINTS' THEN (SELECT count(*) FROM lineitem)
    WHEN 'FACT_RATINGS' THEN (SELECT count(*) FROM part) ELSE (SELECT count(*) FROM region) END AS row_count
    FROM (VALUES {MATRIX}) m(table_name, column_name, tier, allowed)""",
)
def _(t):
    catalog = catalog_profile(
        {"NHTSA.FACT_COMPLAINTS": t("complaint_facts"), "FACT_RATINGS": t("rating_facts"), "REGION": t("region")}
    )
    counts = catalog.select("table_name", "row_count").distinct()
    return G.access_matrix(catalog).join(counts, "table_name")


VIN = "(contains(lower(question), 'vin') OR contains(lower(question), 'vehicle identification'))"
DETAIL = "(" + " OR ".join(
    f"contains(lower(question), '{w}')"
    for w in ("complaint description", "complaint text", "component description", "recall summary")
) + ")"


@query(
    "G03_screen_text",
    f"""SELECT question_id, question, user_tier, NOT (vin OR detail) AS allowed,
    CASE WHEN vin THEN 'VIN data' WHEN detail THEN 'detailed text fields' END AS reason,
    CASE WHEN vin THEN 'executive' WHEN detail THEN 'manager or executive' END AS required_tier
    FROM (SELECT *, user_tier IN ('analyst', 'manager') AND {VIN} AS vin, user_tier = 'analyst' AND {DETAIL} AS detail
    FROM {{questions}})""",
)
def _(t):
    return G.screen_text(t("questions"), "question", "user_tier")


CLEAN = """trim(regexp_replace(regexp_replace(regexp_replace(sql_text, '(?m)--.*?$', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g'),
    '\\s+', ' ', 'g'))"""


@query(
    "G04_screen_sql",
    f"""SELECT audit_id, c AS clean_sql, array_to_string(list_filter([
    CASE WHEN regexp_matches(u, '\\bDROP\\s+TABLE\\b') THEN 'DROP TABLE' END,
    CASE WHEN regexp_matches(u, '\\bTRUNCATE\\b') THEN 'TRUNCATE' END,
    CASE WHEN regexp_matches(u, '\\b(ALTER|CREATE)\\s+(TABLE|DATABASE|SCHEMA)\\b') THEN 'SCHEMA CHANGE' END,
    CASE WHEN regexp_matches(u, '\\bDELETE\\s+FROM\\b') AND NOT regexp_matches(u, '\\bWHERE\\b') THEN 'DELETE WITHOUT WHERE' END,
    CASE WHEN regexp_matches(u, '\\bUPDATE\\b') AND NOT regexp_matches(u, '\\bWHERE\\b') THEN 'UPDATE WITHOUT WHERE' END],
    lambda x: x IS NOT NULL), '|') AS findings FROM (SELECT audit_id, {CLEAN} AS c, upper({CLEAN}) AS u FROM {{sql_log}})""",
)
def _(t):
    df = G.screen_sql(t("sql_log").select("audit_id", "sql_text"), "sql_text")
    return df.select("audit_id", "clean_sql", F.array_join("findings", "|").alias("findings"))


@query(
    "L04_limited_sql",
    """SELECT audit_id, CASE WHEN regexp_matches(upper(s), 'LIMIT|COUNT\\(|SUM\\(|AVG\\(|MAX\\(|MIN\\(|GROUP BY') THEN s
    ELSE rtrim(s, ';') || ' LIMIT 50' END AS sql_text FROM (SELECT audit_id, sql_text || ';' AS s FROM {sql_log})""",
)
def _(t):
    ended = F.concat("sql_text", F.lit(";"))
    return t("sql_log").select("audit_id", G.limited_sql(ended, 50).alias("sql_text"))


@query(
    "G05_advise_sql",
    """SELECT audit_id, array_to_string(list_filter([
    CASE WHEN contains(u, 'SELECT') AND NOT contains(u, 'LIMIT') AND NOT contains(u, 'COUNT(*)') THEN 'NO LIMIT' END,
    CASE WHEN regexp_matches(u, 'SELECT +[*]') THEN 'SELECT *' END,
    CASE WHEN contains(u, 'WHERE') AND contains(u, 'LIKE ''%') THEN 'LEADING WILDCARD' END],
    lambda x: x IS NOT NULL), '|') AS advice FROM (SELECT audit_id, upper(sql_text) AS u FROM {sql_log})""",
)
def _(t):
    df = G.advise_sql(t("sql_log").select("audit_id", "sql_text"), "sql_text")
    return df.select("audit_id", F.array_join("advice", "|").alias("advice"))


@query(
    "G06_sql_tables",
    f"""SELECT audit_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all({CLEAN},
    {text(rules.TABLE_REFERENCE)}, 1), lambda x: regexp_replace(upper(x), '^[^.]*\\.([^.]*\\.[^.]*)$', '\\1')))), '|') AS tables
    FROM {{sql_log}}""",
)
def _(t):
    df = G.sql_tables(t("sql_log").select("audit_id", "sql_text"), "sql_text")
    return df.select("audit_id", F.array_join("tables", "|").alias("tables"))


REASONS = """list_filter([
    CASE WHEN estimated_cost > mc THEN 'Estimated cost $' || printf('%.2f', estimated_cost) || ' exceeds $' || printf('%.2f', mc)
      || ' limit for ' || user_tier END,
    CASE WHEN estimated_rows > mr THEN 'Estimated ' || format('{:,}', estimated_rows) || ' rows exceeds ' || format('{:,}', mr)
      || ' limit for ' || user_tier END,
    CASE WHEN table_count > mt THEN 'Query uses ' || table_count || ' tables, exceeds ' || mt || ' limit for ' || user_tier END,
    CASE WHEN risk_level = 'high' THEN 'Query marked as HIGH RISK - requires senior approval' END,
    CASE WHEN NOT approved THEN 'Query failed safety validation' END,
    CASE WHEN len(severe) > 0 THEN 'Severe safety concerns: ' || array_to_string(severe, ', ') END],
    lambda x: x IS NOT NULL)"""
APPROVAL = f"""(SELECT *, len(reasons) > 0 AS approval_needed, nullif(array_to_string(reasons, '; '), '') AS reason FROM (
    SELECT *, CASE WHEN user_tier = 'executive' THEN [] ELSE {REASONS} END AS reasons FROM (
      SELECT *, CASE WHEN user_tier = 'manager' THEN 20.0::DOUBLE ELSE 5.0 END AS mc,
        CASE WHEN user_tier = 'manager' THEN 1000000 ELSE 500000 END AS mr, CASE WHEN user_tier = 'manager' THEN 5 ELSE 3 END AS mt,
        list_filter(concerns, lambda x: contains(x, 'DROP') OR contains(x, 'DELETE') OR contains(x, 'TRUNCATE')) AS severe
      FROM {{requests}})))"""


@query("G07_approval_needed", f"SELECT approval_id, user_tier, approval_needed, reason FROM {APPROVAL}")
def _(t):
    return G.approval_needed(t("requests")).select("approval_id", "user_tier", "approval_needed", "reason")


@query(
    "G08_recommend",
    f"""SELECT approval_id, CASE WHEN NOT approved THEN 'REJECT - SQL failed safety validation'
    WHEN approval_needed THEN 'APPROVAL REQUIRED - ' || reason
    WHEN risk_level = 'low' AND estimated_cost < 0.10::DOUBLE THEN 'APPROVE - Low risk, minimal cost'
    WHEN risk_level = 'medium' AND estimated_cost < 1 THEN 'APPROVE - Medium complexity, acceptable cost'
    WHEN warning_count > 0 THEN 'APPROVE WITH CAUTION - ' || warning_count || ' warning(s)'
    ELSE 'APPROVE - Query validated' END AS recommendation FROM {APPROVAL}""",
)
def _(t):
    return G.recommend(G.approval_needed(t("requests"))).select("approval_id", "recommendation")


PENDING = "SELECT approval_id, requester_tier, query_text, created_at FROM {requests} WHERE status = 'pending' AND requester_tier IN "


@query("G09_pending_for_manager", PENDING + "('analyst')")
def _(t):
    return G.pending_for(t("requests"), "manager").select("approval_id", "requester_tier", "query_text", "created_at")


@query("G09_pending_for_executive", PENDING + "('analyst', 'manager')")
def _(t):
    return G.pending_for(t("requests"), "executive").select("approval_id", "requester_tier", "query_text", "created_at")


@query(
    "G09_mine",
    """SELECT approval_id, status, created_at FROM {requests} WHERE requester_username = 'user7'
    ORDER BY created_at DESC, approval_id LIMIT 50""",
)
def _(t):
    return G.mine(t("requests"), "user7").select("approval_id", "status", "created_at")


@query(
    "G10_review",
    """WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY approval_id ORDER BY reviewed_at, approver_user_id) AS r
      FROM (SELECT event_id AS approval_id, CASE WHEN user_id % 2 = 0 THEN 'approved' ELSE 'rejected' END AS status,
        user_id AS approver_user_id, 'boss' || user_id AS approver_username, event_type AS approval_notes, ts AS reviewed_at
        FROM events UNION ALL
        SELECT event_id, 'rejected', 0, 'late', 'too late', ts + INTERVAL 1 DAY FROM events)) WHERE r = 1)
    SELECT q.approval_id, CASE WHEN hit THEN d.status ELSE q.status END AS status,
      CASE WHEN hit THEN d.approver_user_id ELSE q.approver_user_id END AS approver_user_id,
      CASE WHEN hit THEN d.approval_notes ELSE q.approval_notes END AS approval_notes,
      CASE WHEN hit THEN d.reviewed_at ELSE q.reviewed_at END AS reviewed_at
    FROM (SELECT r.*, r.status = 'pending' AND EXISTS (SELECT 1 FROM d WHERE d.approval_id = r.approval_id) AS hit
      FROM {requests} r) q LEFT JOIN d ON q.approval_id = d.approval_id""",
)
def _(t):
    first = t("events").select(
        F.col("event_id").alias("approval_id"),
        F.when(F.col("user_id") % 2 == 0, "approved").otherwise("rejected").alias("status"),
        F.col("user_id").alias("approver_user_id"),
        F.concat(F.lit("boss"), F.col("user_id").cast("string")).alias("approver_username"),
        F.col("event_type").alias("approval_notes"), F.col("ts").alias("reviewed_at"),
    )
    late = t("events").select(
        F.col("event_id").alias("approval_id"), F.lit("rejected").alias("status"), F.lit(0).cast("long").alias("approver_user_id"),
        F.lit("late").alias("approver_username"), F.lit("too late").alias("approval_notes"),
        (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("reviewed_at"),
    )
    done = G.review(t("requests"), first.unionByName(late))
    return done.select("approval_id", "status", "approver_user_id", "approval_notes", "reviewed_at")


# --- profiles and charts ------------------------------------------------------------------


def role_rows(table: str, kinds: dict[str, str]) -> str:
    """kinds: column -> 'number', 'text', 'time', or '' for a column without a role."""
    few = "count(DISTINCT {c}) + CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END <= 10 AND count(*) > 50"
    roles = {"number": f"CASE WHEN {few} THEN 'Cat' ELSE 'Quant' END", "text": "'Cat'", "time": "'Time'"}
    return " UNION ALL ".join(
        f"SELECT {i} AS position, '{c.upper()}' AS column_name, {roles[k].format(c=c)} AS role, "
        f"count(DISTINCT {c}) AS n_distinct FROM {table}"
        for i, (c, k) in enumerate(kinds.items()) if k
    )


LINE_ROLES = {
    "l_orderkey": "number", "l_partkey": "number", "l_suppkey": "number", "l_linenumber": "number", "l_quantity": "number",
    "l_extendedprice": "number", "l_discount": "number", "l_tax": "number", "l_returnflag": "text", "l_linestatus": "text",
    "l_shipdate": "time",
}
EVENT_ROLES = {"event_id": "", "ts": "time", "user_id": "", "event_type": "text", "value": "number", "props": "text"}


@query("M01_column_roles", role_rows("lineitem", LINE_ROLES))
def _(t):
    return M.column_roles(t("lineitem")).drop("is_exact")


@query(
    "M01_column_roles_estimated",
    f"""SELECT position, column_name, role, CASE WHEN n_distinct < {M.EXACT_DISTINCT} THEN n_distinct END AS n_distinct,
    n_distinct < {M.EXACT_DISTINCT} AS is_exact FROM ({role_rows('lineitem', LINE_ROLES)})""",
)
def _(t):
    roles = M.column_roles(t("lineitem"), exact=False)
    return roles.withColumn("n_distinct", F.when(F.col("is_exact"), F.col("n_distinct")))


@query(
    "M01_merged_loads",
    f"""SELECT position, column_name, role, CASE WHEN n_distinct < {M.EXACT_DISTINCT} THEN n_distinct END AS n_distinct,
    n_distinct < {M.EXACT_DISTINCT} AS is_exact FROM ({role_rows('lineitem', LINE_ROLES)})""",
)
def _(t):
    # the statistics of three loads are kept as tables and added up; the second and third load read no old row
    path = new_path(t.spark, "sketches")
    for load in range(3):
        part = t("lineitem").where(F.col("l_orderkey") % 3 == load)
        M.role_sketches(part).write.mode("append").parquet(path)
    roles = M.roles_of(M.merge_sketches(t.spark.read.schema(M.ROLE_SKETCHES).parquet(path)))
    return roles.withColumn("n_distinct", F.when(F.col("is_exact"), F.col("n_distinct")))


@query("M01_column_roles_events", role_rows("events", EVENT_ROLES))
def _(t):
    return M.column_roles(t("events")).drop("is_exact")


@query(
    "M02_pick_chart",
    """SELECT * FROM (VALUES ('nation', 'scatter', 'N_NAME', 'N_NATIONKEY', 'N_REGIONKEY'),
    ('types', 'bar', 'EVENT_TYPE', 'VALUE', NULL), ('events', 'box', 'PROPS', 'VALUE', NULL))
    v(frame, chart, category, measure, second_measure)
    WHERE (SELECT count(*) FROM events) > 50 AND (SELECT count(DISTINCT event_type) FROM events) BETWEEN 5 AND 20""",
)
def _(t):
    frames = {
        "nation": t("nation"), "types": t("events").select("event_type", "value"),
        "events": t("events").select("event_type", "value", "props"),
    }
    picks = [M.pick_chart(M.column_roles(df)).withColumn("frame", F.lit(name)) for name, df in frames.items()]
    return picks[0].unionByName(picks[1]).unionByName(picks[2])


@query("M03_chart_rows", "SELECT c_mktsegment, c_acctbal FROM customer")
def _(t):
    return M.chart_rows(t("customer"), "c_mktsegment", "c_acctbal")


@query(
    "M03_quartiles",
    """SELECT o_orderpriority, count(*) AS n, min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 4) AS q1,
    round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS q3,
    max(o_totalprice) AS max FROM orders GROUP BY 1""",
)
def _(t):
    q = M.quartiles(t("orders"), "o_orderpriority", "o_totalprice")
    return q.select("o_orderpriority", "n", "min", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")], "max")


@query(
    "M03_quartiles_of_few_values",
    """SELECT l_returnflag, count(*) AS n, min(l_quantity) AS min, quantile_cont(l_quantity, 0.25) AS q1,
    quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.75) AS q3, max(l_quantity) AS max
    FROM lineitem GROUP BY 1""",
)
def _(t):
    return M.quartiles(t("lineitem"), "l_returnflag", "l_quantity")


@query(
    "M04_schema_docs",
    """SELECT table_name, n AS row_count, c AS column_count, 'Table: ' || table_name || chr(10) || 'Row Count: ' || format('{:,}', n)
    || chr(10) || 'Columns (' || c || '):' || chr(10) || body AS content FROM (
    SELECT 'region' AS table_name, (SELECT count(*) FROM region) AS n, 2::BIGINT AS c,
      '- r_regionkey (int)' || chr(10) || '- r_name (string)' AS body
    UNION ALL SELECT 'labels', (SELECT count(*) FROM labels), 3,
      '- doc_id (bigint) [KEY]' || chr(10) || '- quality (int)' || chr(10) || '- toxic (int)')""",
)
def _(t):
    return M.schema_docs(catalog_profile({"region": t("region"), "labels": t("labels")}))


@query(
    "M05_vector_topk",
    """SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), 4)
    AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[],
    (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]) DESC, vec_id LIMIT 5""",
)
def _(t):
    target = t("embeddings").filter(F.col("vec_id") == 0).select("embedding")
    top = M.vector_topk(t("embeddings"), target, 5)
    return top.select("vec_id", "label", F.round("score", 4).alias("score"))


COSINE = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(
    "M05_vector_topk_many",
    f"""SELECT query_id, rank, vec_id, round(score, 4) AS score FROM (
      SELECT q.vec_id AS query_id, e.vec_id, {COSINE} AS score,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE} DESC, e.vec_id)::INTEGER AS rank
      FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id < 20) q) WHERE rank <= 5""",
)
def _(t):
    queries = t("embeddings").filter(F.col("vec_id") < 20).select(F.col("vec_id").alias("query_id"), "embedding")
    top = V.vector_topk_many(t("embeddings").repartition(t.parts), queries, 5)
    return top.withColumn("score", F.round("score", 4))


@query(
    "M05_pivot_topk",
    """SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), 4)
    AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[],
    (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]) DESC, vec_id LIMIT 5""",
)
def _(t):
    path = new_path(t.spark, "pivots")
    V.write_pivots(t("embeddings"), path)
    target = t("embeddings").filter(F.col("vec_id") == 0).first()["embedding"]
    top, _read = V.pivot_topk(t.spark, path, target, 5)
    return top.select("vec_id", "label", F.round("score", 4).alias("score"))


SPREADS = {
    "ties": "CAST(l_linenumber AS DOUBLE)", "outlier": "CASE WHEN l_orderkey = 1 THEN 1e300 ELSE l_extendedprice END",
    "distinct": "CAST(l_orderkey * 8 + l_linenumber AS DOUBLE)",
}


@query(
    "M03_quartiles_of_any_spread",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS spread, count(*) AS n, min({v}) AS min, round(quantile_cont({v}, 0.25), 4) AS q1,
        round(quantile_cont({v}, 0.5), 4) AS median, round(quantile_cont({v}, 0.75), 4) AS q3, max({v}) AS max FROM lineitem"""
        for name, v in SPREADS.items()
    ),
)
def _(t):
    # coarse sketches and small lists: most ranks take several rounds
    values = [F.struct(F.lit(name).alias("spread"), F.expr(v).cast("double").alias("v")) for name, v in SPREADS.items()]
    rows = t("lineitem").select(F.inline(F.array(*values)))
    q = M.quartiles(rows, "spread", "v", accuracy=50, few=100)
    return q.select("spread", "n", "min", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")], "max")


def _text_upsert(t, chars):
    docs = t("documents").select("doc_id", "text")
    changes = docs.select((F.col("doc_id") + 100).alias("doc_id"), F.concat(F.lit("new "), "text").alias("text"), F.lit(0).alias("seq"))
    return upsert_texts(docs, changes, "seq", "doc_id", chars)


TEXT_UPSERT = """SELECT coalesce(u.doc_id, d.doc_id) AS doc_id, coalesce(u.text, d.text) AS text
    FROM documents d FULL JOIN (SELECT doc_id + 100 AS doc_id, {} AS text FROM documents) u ON d.doc_id = u.doc_id"""


@query("M06_vector_upsert", TEXT_UPSERT.format("'new ' || text"))
def _(t):
    return _text_upsert(t, None)


@query("M06_vector_upsert_short", TEXT_UPSERT.format("left('new ' || text, 1000)"))
def _(t):
    return _text_upsert(t, 1000)
