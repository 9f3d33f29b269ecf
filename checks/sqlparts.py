"""SQL pieces for the oracles, written for DuckDB."""

from __future__ import annotations

from carlake import rules
from checks.inputs import text


def names(c: str) -> str:
    cases = " ".join(
        f"WHEN upper(trim({c})) IN ({', '.join(text(s) for s in spellings)}) THEN {text(name)}"
        for name, spellings in rules.MAKER_VARIANTS.items()
    )
    return f"CASE {cases} ELSE {c} END"


def in_list(values) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


MAKERS = in_list(rules.MAKERS)


def whole(c: str) -> str:
    return f"CAST(trunc(TRY_CAST({c} AS DOUBLE)) AS INTEGER)"


def year(c: str, lo: int = 1990, hi: int = 2030) -> str:
    return f"CASE WHEN {whole(c)} BETWEEN {lo} AND {hi} THEN {whole(c)} END"


def date8(c: str) -> str:
    return f"CASE WHEN length({c}) = 8 THEN CAST(try_strptime({c}, '%Y%m%d') AS DATE) END"


def date(c: str) -> str:
    return (
        f"CASE WHEN {c} NOT IN ('99999999', '00000000', '', ' ') AND year({date8(c)}) >= 1990 THEN {date8(c)} END"
    )


def clean(c: str) -> str:
    untagged = f"regexp_replace({c}, '<[^>]*>', '', 'g')"
    for wrong, right in rules.MOJIBAKE:
        untagged = f"replace({untagged}, {text(wrong)}, {text(right)})"
    return f"nullif(trim(regexp_replace({untagged}, '\\s+', ' ', 'g')), '')"


def yn(c: str) -> str:
    return f"CASE upper(trim({c})) WHEN 'Y' THEN true WHEN 'N' THEN false END"


def count(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 0 ELSE {whole(c)} END"


def clamp(c: str, lo: float, hi: float) -> str:
    return f"CASE WHEN TRY_CAST({c} AS DOUBLE) BETWEEN {lo} AND {hi} THEN TRY_CAST({c} AS DOUBLE) END"


def star(c: str) -> str:
    return (
        f"CASE WHEN upper(trim({c})) NOT IN ('NOT RATED', 'N/A', 'NA', '', '-') THEN {clamp(c, 1, 5)} END"
    )


def feature(c: str) -> str:
    return f"coalesce(upper(trim({c})) IN ('STANDARD', 'OPTIONAL', 'YES'), false)"


def key(*cols: str) -> str:
    return "sha256(" + " || '_' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in cols) + ")"


def component(c: str) -> str:
    cases = " ".join(
        f"WHEN contains(upper({c}), {text(word)}) THEN {text(name)}" for word, name in rules.COMPONENT_RULES
    )
    return f"CASE {cases} ELSE 'OTHER' END"


def severity(deaths: str, injured: str, crash: str, fire: str) -> str:
    return (
        f"CASE WHEN {deaths} > 0 THEN 'CRITICAL' WHEN {injured} > 0 THEN 'HIGH' "
        f"WHEN {crash} OR {fire} THEN 'MEDIUM' ELSE 'LOW' END"
    )


def any_word(low: str, words) -> str:
    return "(" + " OR ".join(f"contains({low}, {text(w)})" for w in words) + ")"


def keep_first(source: str, keys: str) -> str:
    """One row per key: the least over all columns, NULL first."""
    return (
        f"(SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ALL_COLUMNS) AS _rn "
        f"FROM {source}) WHERE _rn = 1)"
    )
