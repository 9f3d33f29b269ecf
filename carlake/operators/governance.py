"""Column access, text and SQL-log screens, and the approval queue, as table jobs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carlake import rules
from carlake.functions.derived import any_of, first_match
from carlake.functions.text import has_any
from carlake.operators.aggregates import top_n
from carlake.operators.joins import apply_thresholds


# --- column access ---------------------------------------------------------------


def _bare(table: str) -> str:
    return table.split(".")[-1].upper()


def allowed_columns(tier: str, table: str) -> str | list[str]:
    """The permitted columns, or '*'. A table without a rule is closed to analysts and managers."""
    table = _bare(table)
    own = rules.ANALYST_COLUMNS.get(table, [])
    if tier == "analyst":
        return own
    if tier == "manager":
        more = rules.MANAGER_COLUMNS.get(table, [])
        return rules.ALL if rules.ALL in (own, more) else own + more
    return rules.ALL


def blocked_columns(tier: str, table: str) -> list[str]:
    by_tier = {"analyst": rules.ANALYST_BLOCKED, "manager": rules.MANAGER_BLOCKED}
    return by_tier.get(tier, {}).get(_bare(table), [])


def may_read(tier: str, table: str, column: str) -> bool:
    """The block list counts only where everything is allowed."""
    allowed = allowed_columns(tier, table)
    if allowed == rules.ALL:
        return column.lower() not in blocked_columns(tier, table)
    return column.lower() in allowed


def project_for_tier(df: DataFrame, table: str, tier: str) -> DataFrame:
    """The columns the tier may read, so that the others are never scanned."""
    return df.select(*[c for c in df.columns if may_read(tier, table, c)])


def access_matrix(catalog: DataFrame) -> DataFrame:
    """Tier x table x column -> allowed. ``catalog`` has ``table_name`` and ``column_name``."""
    names, column = F.upper(F.element_at(F.split("table_name", r"\."), -1)), F.lower("column_name")

    def lists(by_table: Mapping[str, object]) -> Column:
        """The table's rule as an array; ['*'] stands for all."""
        out = F
        for table, cols in by_table.items():
            values = [cols] if cols == rules.ALL else cols
            out = out.when(names == table, F.array(*[F.lit(v) for v in values]))
        return out.otherwise(F.array().cast("array<string>"))

    own = lists(rules.ANALYST_COLUMNS)
    more = F.concat(own, lists(rules.MANAGER_COLUMNS))
    everything = F.lit(rules.ALL)

    def readable(allowed: Column, blocked: Column) -> Column:
        return F.when(F.array_contains(allowed, everything), ~F.array_contains(blocked, column)).otherwise(
            F.array_contains(allowed, column)
        )

    verdicts = F.array(
        F.struct(F.lit("analyst").alias("tier"), readable(own, lists(rules.ANALYST_BLOCKED)).alias("allowed")),
        F.struct(F.lit("manager").alias("tier"), readable(more, lists(rules.MANAGER_BLOCKED)).alias("allowed")),
        F.struct(F.lit("executive").alias("tier"), F.lit(True).alias("allowed")),
    )
    return catalog.select("table_name", "column_name", F.inline(verdicts))


# --- screens ------------------------------------------------------------------------


def screen_text(df: DataFrame, text: str, tier: str) -> DataFrame:
    """Whether the question may be asked by the tier, why not, and the tier it needs."""
    low, who = F.lower(text), F.col(tier)
    vin = who.isin("analyst", "manager") & has_any(low, rules.VIN_WORDS)
    detail = (who == "analyst") & has_any(low, rules.DETAIL_WORDS)
    nothing = F.lit(None).cast("string")
    return df.select(
        "*",
        F.coalesce(~(vin | detail), F.lit(True)).alias("allowed"),
        first_match([(vin, "VIN data"), (detail, "detailed text fields")], nothing).alias("reason"),
        first_match([(vin, "executive"), (detail, "manager or executive")], nothing).alias("required_tier"),
    )


def clean_sql(c: Column) -> Column:
    """SQL text without comments and on one line."""
    text = F.regexp_replace(c, r"(?dm)--.*?$", "")
    text = F.regexp_replace(text, r"(?s)/\*.*?\*/", "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def screen_sql(df: DataFrame, sql: str) -> DataFrame:
    """Adds the cleaned SQL text and the list of its dangerous operations."""
    df = df.select("*", clean_sql(F.col(sql)).alias("clean_sql"))
    df = df.select("*", F.upper("clean_sql").alias("_upper"))
    up = F.col("_upper")
    no_where = ~up.rlike(r"\bWHERE\b")
    findings = [(up.rlike(pattern), name) for pattern, name in rules.DANGEROUS_SQL]
    findings += [(up.rlike(pattern) & no_where, name) for pattern, name in rules.DANGEROUS_WITHOUT_WHERE]
    found = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in findings]))
    return df.select("*", found.alias("findings")).drop("_upper")


def advise_sql(df: DataFrame, sql: str) -> DataFrame:
    """Adds the list of style advices for a query text."""
    df = df.select("*", F.upper(sql).alias("_upper"))
    up = F.col("_upper")
    advice = [
        (up.contains("SELECT") & ~up.contains("LIMIT") & ~up.contains("COUNT(*)"), "NO LIMIT"),
        (up.rlike(rules.STAR_SQL), "SELECT *"),
        (up.contains("WHERE") & up.rlike(rules.LEADING_WILDCARD), "LEADING WILDCARD"),
    ]
    found = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in advice]))
    return df.select("*", found.alias("advice")).drop("_upper")


def sql_tables(df: DataFrame, sql: str) -> DataFrame:
    """Adds the distinct tables named after FROM or JOIN: upper case, the last two name parts."""
    found = F.regexp_extract_all(clean_sql(F.col(sql)), F.lit(rules.TABLE_REFERENCE), F.lit(1))
    last_two = F.transform(found, lambda t: F.substring_index(F.upper(t), ".", -2))
    return df.select("*", F.array_sort(F.array_distinct(last_two)).alias("tables"))


# --- approval ---------------------------------------------------------------------------


def two_decimals(c: Column) -> Column:
    """Text with two decimals, rounded by the exact binary value (8.065 is stored below 8.065, so 8.06).

    Java's formatting rounds the shortest decimal text instead, which differs at such halves. For values
    from 1 on the fraction is a whole number of 2^-52, so the cents follow in integer arithmetic."""
    unit = 2**52
    scaled = ((c - F.floor(c)) * F.lit(float(unit))).cast("bigint") * 100
    cents, rest = F.shiftright(scaled, 52), F.pmod(scaled, F.lit(unit))
    up = (rest > unit // 2) | ((rest == unit // 2) & (cents % 2 == 1))
    total = F.floor(c) * 100 + cents + F.when(up, 1).otherwise(0)
    low = F.pmod(total, F.lit(100))
    return F.concat(((total - low) / 100).cast("bigint").cast("string"), F.lit("."), F.lpad(low.cast("string"), 2, "0"))


def approval_needed(df: DataFrame, limits=rules.APPROVAL_LIMITS) -> DataFrame:
    """Adds whether a person must approve the query, and why.

    Reads user_tier, estimated_cost, estimated_rows, table_count, risk_level, approved and the array
    concerns. The executive is exempt."""
    df = apply_thresholds(df, "user_tier", limits)
    tier = F.col("user_tier")
    severe = F.filter("concerns", lambda c: has_any(c, rules.SEVERE_WORDS))
    reasons = [
        (
            F.col("estimated_cost") > F.col("max_cost"),
            F.concat(
                F.lit("Estimated cost $"), two_decimals(F.col("estimated_cost")), F.lit(" exceeds $"),
                F.format_string("%.2f", "max_cost"), F.lit(" limit for "), tier,
            ),
        ),
        (
            F.col("estimated_rows") > F.col("max_rows"),
            F.concat(
                F.lit("Estimated "), F.format_number("estimated_rows", 0), F.lit(" rows exceeds "),
                F.format_number("max_rows", 0), F.lit(" limit for "), tier,
            ),
        ),
        (
            F.col("table_count") > F.col("max_tables"),
            F.concat(
                F.lit("Query uses "), F.col("table_count").cast("string"), F.lit(" tables, exceeds "),
                F.format_number("max_tables", 0), F.lit(" limit for "), tier,
            ),
        ),
        (F.col("risk_level") == "high", F.lit("Query marked as HIGH RISK - requires senior approval")),
        (~F.col("approved"), F.lit("Query failed safety validation")),
        (
            F.size(severe) > 0,
            F.concat(F.lit("Severe safety concerns: "), F.array_join(severe, ", ")),
        ),
    ]
    listed = F.array_compact(F.array(*[F.when(cond, text) for cond, text in reasons]))
    listed = F.when(tier == "executive", F.array().cast("array<string>")).otherwise(listed)
    df = df.select("*", listed.alias("_reasons")).drop("max_cost", "max_rows", "max_tables")
    needed = F.size("_reasons") > 0
    return df.select(
        "*", needed.alias("approval_needed"), F.when(needed, F.array_join("_reasons", "; ")).alias("reason")
    ).drop("_reasons")


def recommend(df: DataFrame) -> DataFrame:
    """Adds the recommendation; reads the columns of ``approval_needed`` and the number of warnings."""
    risk, cost = F.col("risk_level"), F.col("estimated_cost")
    cases = [
        (~F.col("approved"), F.lit("REJECT - SQL failed safety validation")),
        (F.col("approval_needed"), F.concat(F.lit("APPROVAL REQUIRED - "), F.col("reason"))),
        ((risk == "low") & (cost < 0.10), F.lit("APPROVE - Low risk, minimal cost")),
        ((risk == "medium") & (cost < 1.00), F.lit("APPROVE - Medium complexity, acceptable cost")),
        (
            F.col("warning_count") > 0,
            F.concat(
                F.lit("APPROVE WITH CAUTION - "), F.col("warning_count").cast("string"), F.lit(" warning(s)")
            ),
        ),
    ]
    return df.select("*", first_match(cases, F.lit("APPROVE - Query validated")).alias("recommendation"))


def pending_for(queue: DataFrame, tier: str) -> DataFrame:
    """Open requests the tier may decide, newest first."""
    decides = {"manager": ["analyst"], "executive": ["analyst", "manager"]}.get(tier, [])
    open_requests = queue.filter((F.col("status") == "pending") & F.col("requester_tier").isin(decides))
    return open_requests.orderBy(F.desc("created_at"), F.asc("approval_id"))


def mine(queue: DataFrame, user: int | str, limit: int = 50) -> DataFrame:
    """The newest requests of one user, by id or by name."""
    col = "requester_user_id" if isinstance(user, int) else "requester_username"
    return top_n(queue.filter(F.col(col) == user), [F.desc("created_at"), F.asc("approval_id")], limit)


def review(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """The queue after the decisions; only a request that is still pending changes.

    The first decision on a request counts, by ``reviewed_at`` and approver. ``decisions`` has approval_id,
    status, approver_user_id, approver_username, approval_notes and reviewed_at."""
    fields = ["status", "approver_user_id", "approver_username", "approval_notes", "reviewed_at"]
    first = decisions.groupBy("approval_id").agg(
        F.min_by(F.struct(*fields), F.struct("reviewed_at", "approver_user_id")).alias("_decision")
    )
    joined = queue.join(first, "approval_id", "left")
    taken = (F.col("status") == "pending") & F.col("_decision").isNotNull()
    return joined.select(
        *[
            F.when(taken, F.col(f"_decision.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
            for c in queue.columns
        ]
    )


def limited_sql(sql: Column, n: int = 100) -> Column:
    """A statement with a limit behind it, unless it has one already or aggregates."""
    upper = F.upper(sql)
    free = any_of([F.contains(upper, F.lit(w)) for w in rules.UNLIMITED_SQL])
    return F.when(free, sql).otherwise(F.concat(F.rtrim(sql, F.lit(";")), F.lit(f" LIMIT {n}")))
