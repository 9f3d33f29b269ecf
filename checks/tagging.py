"""T operators: rules over text."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from carlake import rules
from carlake.functions import cleaning as C
from carlake.functions import derived as D
from carlake.functions import text as T
from carlake.operators.filters import keep_names
from carlake.plans import news
from carlake.session import spread
from checks import sqlparts as S
from checks.inputs import text as lit
from checks.registry import query

AS_OF = datetime(2026, 1, 1)


def joined(c):
    return F.array_join(c, "|")


# --- complaint sentiment ------------------------------------------------------------------

TOKENS = """list_filter(string_split_regex(lower(CDESCR), '[^a-z'']+'), lambda w: w <> '')"""
TOKENS_OF = """list_filter(string_split_regex(lower({}), '[^a-z'']+'), lambda w: w <> '')"""
WEIGHT = "CASE w " + " ".join(f"WHEN {lit(w)} THEN {n}" for w, n in rules.lexicon().items()) + " ELSE 0 END"
NEGATORS = S.in_list(rules.NEGATORS)
SUMS = f"""signed AS (SELECT *, list_transform(t, lambda w, i: ({WEIGHT}) * CASE WHEN (i > 1 AND t[i - 1] IN {NEGATORS})
    OR (i > 2 AND t[i - 2] IN {NEGATORS}) THEN -1 ELSE 1 END) AS s FROM tok),
sums AS (SELECT *, CASE WHEN s IS NULL THEN NULL ELSE CAST(coalesce(list_sum(list_filter(s, lambda x: x > 0)), 0) AS INTEGER) END AS p,
    CASE WHEN s IS NULL THEN NULL ELSE CAST(coalesce(-list_sum(list_filter(s, lambda x: x < 0)), 0) AS INTEGER) END AS n FROM signed)
"""
SENTIMENT = f"WITH tok AS (SELECT CMPLID, CDESCR, {TOKENS} AS t FROM {{complaints_raw}}), {SUMS}"
SCORE = "CASE WHEN p + n = 0 THEN 0.0::DOUBLE ELSE (p - n) / CAST(p + n AS DOUBLE) END"
LABEL = "CASE WHEN p > n THEN 'positive' WHEN p < n THEN 'negative' WHEN p = n THEN 'neutral' END"
CONFIDENCE = "(p + n) / CAST(p + n + 3 AS DOUBLE)"


@query(
    "T01_sentiment",
    SENTIMENT
    + f"""SELECT CMPLID, CDESCR, {SCORE} AS sentiment_score, {LABEL} AS sentiment_label,
    {CONFIDENCE} AS sentiment_confidence FROM sums""",
)
def _(t):
    return T.with_sentiment(t("complaints_raw").select("CMPLID", "CDESCR"), "CDESCR", parts=t.parts).drop(
        "negation_count", "safety_keyword_count"
    )


@query(
    "N08_worst_sentiment",
    SENTIMENT
    + f""", named AS (SELECT CMPLID, coalesce({S.names('MAKETXT')}, {S.names('MFR_NAME')}) AS make FROM {{complaints_raw}}),
    scored AS (SELECT CMPLID, CASE WHEN p + n = 0 THEN 0.0::DOUBLE ELSE (p - n) / CAST(p + n AS DOUBLE) END AS s FROM sums),
    one AS (SELECT CMPLID, any_value(s) AS s FROM scored GROUP BY 1), many AS (SELECT CMPLID, make FROM named)
    SELECT make, round(avg(s), 3) AS avg_sentiment, count(*) AS n, count(*) FILTER (s < -0.5) AS very_negative
    FROM many JOIN one USING (CMPLID) WHERE make IN {S.MAKERS} GROUP BY make""",
)
def _(t):
    maker = C.first_name(C.standardize_name(F.col("MAKETXT")), C.standardize_name(F.col("MFR_NAME")))
    rows = keep_names(t("complaints_raw").select(maker.alias("make"), "CDESCR"), "make")
    scored = T.with_sentiment(rows, "CDESCR", parts=t.parts)
    category = D.sentiment_band(F.col("sentiment_score"))
    return (
        scored.groupBy("make")
        .agg(
            F.round(F.avg("sentiment_score"), 3).alias("avg_sentiment"), F.count("*").alias("n"),
            F.count_if(category == "VERY_NEGATIVE").alias("very_negative"),
        )
        .orderBy("avg_sentiment", "make")
    )


@query(
    "T02_negation_count",
    f"""SELECT CMPLID, CAST(len(list_filter({TOKENS}, lambda w: w IN {NEGATORS})) AS INTEGER) AS negation_count
    FROM {{complaints_raw}}""",
)
def _(t):
    return spread(t("complaints_raw").select("CMPLID", "CDESCR"), t.parts).select(
        "CMPLID", T.count_terms(T.tokens(F.col("CDESCR")), rules.NEGATORS).alias("negation_count")
    )


@query(
    "T03_safety_word_count",
    f"""SELECT CMPLID, CAST(len(list_filter({TOKENS}, lambda w: w IN {S.in_list(rules.SAFETY_WORDS)})) AS INTEGER) AS safety_words
    FROM {{complaints_raw}}""",
)
def _(t):
    return spread(t("complaints_raw").select("CMPLID", "CDESCR"), t.parts).select(
        "CMPLID", T.count_terms(T.tokens(F.col("CDESCR")), rules.SAFETY_WORDS).alias("safety_words")
    )


EMBEDDING_DIM = 768


def embedding_sql(text: str, dim: int = EMBEDDING_DIM) -> str:
    """Digest of the content: each non-zero place with its value in millionths, in order, as text."""
    bucket = "CAST('0x' || left(md5(w), 8) AS BIGINT)"
    return f"""(SELECT coalesce(string_agg(b || ':' || CAST(floor(CAST(CAST(c / sqrt(q) AS FLOAT) AS DOUBLE) * 1e6) AS BIGINT), ',' ORDER BY b), '')
    FROM (SELECT b, c, sum(c * c) OVER () AS q FROM (SELECT {bucket} % {dim} AS b, CAST(count(*) AS DOUBLE) AS c
      FROM (SELECT unnest(regexp_extract_all(lower({text}), '[^\\x20\\x09-\\x0D]+')) AS w) GROUP BY b)))"""


@F.arrow_udf(StringType())
def embedding_digest(embedding: pa.Array) -> pa.Array:
    """The same of an embedding."""
    sizes = pc.list_value_length(embedding).fill_null(0).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    values = embedding.flatten().fill_null(0).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(values)
    rows = np.searchsorted(starts, at, side="right") - 1
    millionths = np.floor(values[at].astype(float) * 1e6).astype(np.int64)
    places = pa.array(at - starts[rows], pa.int64())
    items = pc.binary_join_element_wise(places.cast("string"), pa.array(millionths).cast("string"), ":")
    ends = np.searchsorted(rows, np.arange(len(embedding) + 1))
    joined_items = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items), ",")
    return pc.if_else(embedding.is_null(), pa.scalar(None, pa.string()), joined_items)


@query("T04_embed_text", f"SELECT doc_id, {EMBEDDING_DIM} AS dim, md5(content) AS content FROM (SELECT doc_id, {embedding_sql('text')} AS content FROM documents)")
def _(t):
    df = T.embed_text(t("documents").select("doc_id", "text"), "text", EMBEDDING_DIM, parts=t.parts)
    return df.select("doc_id", F.size("embedding").alias("dim"), F.md5(embedding_digest("embedding")).alias("content"))


# --- news ---------------------------------------------------------------------------------

ARTICLE = "(SELECT article_id, title, summary, title || ' ' || summary AS x, lower(title || ' ' || summary) AS low FROM {articles_raw})"


def article(t):
    df = spread(t("articles_raw").select("article_id", F.concat_ws(" ", "title", "summary").alias("x")), t.parts)
    return df.select("*", F.lower("x").alias("low"))


def weights(groups) -> str:
    return " + ".join(
        f"CASE WHEN contains(low, {lit(w)}) THEN {n} ELSE 0 END" for n, words in groups for w in words
    )


NEWS_SENTIMENT = f"""CASE WHEN ({weights(rules.NEGATIVE_WORDS)}) > ({weights(rules.POSITIVE_WORDS)}) + 1 THEN 'negative'
    WHEN ({weights(rules.POSITIVE_WORDS)}) > ({weights(rules.NEGATIVE_WORDS)}) + 1 THEN 'positive' ELSE 'neutral' END"""
NEWS_CATEGORY = (
    "CASE " + " ".join(f"WHEN {S.any_word('low', words)} THEN '{name}'" for name, words in rules.NEWS_CATEGORIES)
    + " ELSE 'general' END"
)
BREAKING = S.any_word("low", rules.BREAKING_WORDS)
IMPORTANCE = f"""least(10, 5 + CASE WHEN {NEWS_CATEGORY} IN ('recalls', 'executive', 'financial') THEN 2 ELSE 0 END
    + CASE WHEN {S.any_word('low', rules.URGENT_WORDS)} THEN 2 ELSE 0 END
    + CASE WHEN {S.any_word('low', rules.IMPACT_WORDS)} THEN 1 ELSE 0 END + CASE WHEN {BREAKING} THEN 1 ELSE 0 END)"""
CRITICAL = S.any_word("low", rules.SAFETY_CRITICAL_WORDS)


@query("T05_news_sentiment", f"SELECT article_id, {NEWS_SENTIMENT} AS sentiment FROM {ARTICLE}")
def _(t):
    return article(t).select("article_id", T.news_sentiment(F.col("low")).alias("sentiment"))


@query("T06_news_category", f"SELECT article_id, {NEWS_CATEGORY} AS category FROM {ARTICLE}")
def _(t):
    return article(t).select("article_id", T.news_category(F.col("low")).alias("category"))


@query("T07_importance", f"SELECT article_id, {IMPORTANCE} AS importance_score FROM {ARTICLE}")
def _(t):
    low = F.col("low")
    score = T.importance(low, T.news_category(low), T.is_breaking(low))
    return article(t).select("article_id", score.alias("importance_score"))


@query(
    "T08_news_flags",
    f"""SELECT article_id, {BREAKING} AS is_breaking_news, {NEWS_CATEGORY} = 'recalls' AS is_recall_related,
    {CRITICAL} AS is_safety_critical FROM {ARTICLE}""",
)
def _(t):
    low = F.col("low")
    return article(t).select(
        "article_id", T.is_breaking(low).alias("is_breaking_news"),
        (T.news_category(low) == "recalls").alias("is_recall_related"),
        T.is_safety_critical(low).alias("is_safety_critical"),
    )


def found(pattern: str, any_case: bool = False, x: str = "x") -> str:
    return f"regexp_extract_all({x}, {lit(('(?i)' if any_case else '') + pattern)}, 1)"


def without(lst: str, stop) -> str:
    return f"list_filter({lst}, lambda m: m NOT IN {S.in_list(stop)})"


def first_sorted(lists, n: int | None) -> str:
    cut = "" if n is None else f"[1:{n}]"
    return f"array_to_string(list_sort(list_distinct(flatten([{', '.join(lists)}]))){cut}, '|')"


def makers(x: str = "x", n: int | None = None) -> str:
    stop = rules.MAKER_STOP_WORDS
    return first_sorted(
        [
            found(rules.MAKER_COMPANY, x=x),
            without(found(rules.MAKER_VERB, x=x), stop),
            without(found(rules.MAKER_TITLE, True, x), stop),
            f"list_filter({without(found(rules.MAKER_PLACE, x=x), stop)}, lambda m: length(m) > 2)",
            without(found(rules.MAKER_OWNER, x=x), stop),
            f"CASE WHEN regexp_matches({x}, {lit('(?i)' + rules.VEHICLE_CONTEXT)}) THEN "
            f"{without(found(rules.MAKER_ACRONYM, x=x), rules.ACRONYM_STOP_WORDS)} ELSE [] END",
        ],
        n,
    )


PREFIXES = " OR ".join(f"starts_with(lower(m), {lit(p)})" for p in rules.MODEL_NOT_PREFIXES)
MODEL_LISTS = [found(p) for p in rules.MODEL_PATTERNS] + [
    f"list_filter({found(rules.MODEL_HYPHEN)}, lambda m: NOT ({PREFIXES}))"
]
PEOPLE_LISTS = [
    found(rules.PERSON_TITLED), found(rules.PERSON_APPOSITION, True),
    f"list_filter({found(rules.PERSON_SPEAKS)}, lambda m: split_part(m, ' ', 1) NOT IN {S.in_list(rules.PERSON_NOT_FIRST)})",
]
PLACE_LISTS = [found(p) for p in rules.PLACE_PATTERNS]
MODELS, PEOPLE, PLACES = (first_sorted(lists, None) for lists in (MODEL_LISTS, PEOPLE_LISTS, PLACE_LISTS))
# how many mentions to keep, where a report wants few
FEW = {"makers": 2, "models": 1, "people": 1, "places": 1}


@query("T09_extract_makers", f"SELECT article_id, {makers()} AS makers FROM {ARTICLE}")
def _(t):
    return article(t).select("article_id", joined(T.extract_makers(F.col("x"))).alias("makers"))


@query("T10_extract_models", f"SELECT article_id, {MODELS} AS models FROM {ARTICLE}")
def _(t):
    return article(t).select("article_id", joined(T.extract_models(F.col("x"))).alias("models"))


@query("T11_extract_people", f"SELECT article_id, {PEOPLE} AS people FROM {ARTICLE}")
def _(t):
    return article(t).select("article_id", joined(T.extract_people(F.col("x"))).alias("people"))


@query("T12_extract_places", f"SELECT article_id, {PLACES} AS places FROM {ARTICLE}")
def _(t):
    return article(t).select("article_id", joined(T.extract_places(F.col("x"))).alias("places"))


@query(
    "T12_extract_few",
    f"""SELECT article_id, {makers(n=FEW["makers"])} AS makers, {first_sorted(MODEL_LISTS, FEW["models"])} AS models,
    {first_sorted(PEOPLE_LISTS, FEW["people"])} AS people, {first_sorted(PLACE_LISTS, FEW["places"])} AS places FROM {ARTICLE}""",
)
def _(t):
    finders = {"makers": T.extract_makers, "models": T.extract_models, "people": T.extract_people, "places": T.extract_places}
    return article(t).select("article_id", *[joined(fn(F.col("x"), FEW[k])).alias(k) for k, fn in finders.items()])


EVENT_PLACE = "coalesce(" + ", ".join(
    f"nullif(regexp_extract(block_text, {lit(p)}, 1), '')" for p in rules.EVENT_PLACE_PATTERNS
) + ")"


@query("T12_event_place", f"SELECT event_id, block_text, {EVENT_PLACE} AS place FROM {{blurbs}}")
def _(t):
    return t("blurbs").select("event_id", "block_text", T.event_place(F.col("block_text")).alias("place"))


@query(
    "T12_tag_articles",
    f"""SELECT a.title, a.url, a.published_date, a.source, a.author, a.summary, {NEWS_CATEGORY} AS category,
    {NEWS_SENTIMENT} AS sentiment, {IMPORTANCE} AS importance_score, {makers()} AS mentioned_manufacturers,
    {MODELS} AS mentioned_models, {PEOPLE} AS mentioned_executives, {PLACES} AS mentioned_locations,
    {BREAKING} AS is_breaking_news, {NEWS_CATEGORY} = 'recalls' AS is_recall_related, {CRITICAL} AS is_safety_critical,
    TIMESTAMP '2026-01-01 00:00:00' AS scraped_at
    FROM {{articles_raw}} a JOIN {ARTICLE} b USING (article_id)""",
)
def _(t):
    df = news.tag_articles(t("articles_raw"), AS_OF, parts=t.parts)
    lists = ["mentioned_manufacturers", "mentioned_models", "mentioned_executives", "mentioned_locations"]
    return df.select(*[joined(c).alias(c) if c in lists else F.col(c) for c in df.columns])


# --- trade events -------------------------------------------------------------------------

EVENT = "(SELECT *, title || ' ' || block_text AS x, lower(title || ' ' || block_text) AS low FROM {blurbs})"


def event(t):
    df = spread(t("blurbs"), t.parts).select("*", F.concat_ws(" ", "title", "block_text").alias("x"))
    return df.select("*", F.lower("x").alias("low"))


EVENT_TYPE = (
    "CASE " + " ".join(f"WHEN {S.any_word('low', words)} THEN '{name}'" for name, words in rules.EVENT_TYPES)
    + " ELSE 'event' END"
)
TOPICS = "list_filter([" + ", ".join(
    f"CASE WHEN {S.any_word('low', words)} THEN '{name}' END" for name, words in rules.EVENT_TOPICS
) + "], lambda v: v IS NOT NULL)"


@query("T13_event_type", f"SELECT event_id, {EVENT_TYPE} AS event_type FROM {EVENT}")
def _(t):
    return event(t).select("event_id", T.event_type(F.col("low")).alias("event_type"))


@query("T14_event_topics", f"SELECT event_id, array_to_string({TOPICS}, '|') AS topics FROM {EVENT}")
def _(t):
    return event(t).select("event_id", joined(T.event_topics(F.col("low"))).alias("topics"))


def month(c: str) -> str:
    cases = " ".join(
        f"WHEN {c} IN ('{m}', '{m[:3]}') THEN '{i:02d}'" for i, m in enumerate(rules.MONTHS, 1)
    )
    return f"CASE {cases} END"


def dates(x: str) -> tuple[str, str]:
    body = f"regexp_replace(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), {lit('(?i)' + rules.DATE_PREFIX)}, '')"

    def g(pattern: str, i: int) -> str:
        return f"regexp_extract({body}, {lit(pattern)}, {i})"

    def day(y: str, m: str, d: str) -> str:
        return f"CAST(try_strptime({y} || '-' || {m} || '-' || lpad({d}, 2, '0'), '%Y-%m-%d') AS DATE)"

    span, one = rules.DATE_RANGE, rules.DATE_SINGLE
    span_month, one_month = month(g(span, 1)), month(g(one, 1))
    start = f"""CASE WHEN ({span_month}) IS NOT NULL THEN {day(g(span, 4), f'({span_month})', g(span, 2))}
        WHEN ({one_month}) IS NOT NULL THEN {day(g(one, 3), f'({one_month})', g(one, 2))}
        WHEN {g(rules.DATE_YEAR, 1)} <> '' THEN {day(g(rules.DATE_YEAR, 1), "'01'", "'01'")} END"""
    end = f"CASE WHEN ({span_month}) IS NOT NULL THEN {day(g(span, 4), f'({span_month})', g(span, 3))} END"
    return start, end


START, END = dates("date_text")
B_START, B_END = dates("block_text")


@query("T15_event_dates", f"SELECT event_id, date_text, {START} AS date_start, {END} AS date_end FROM {{date_texts}}")
def _(t):
    return T.with_event_dates(t("date_texts"), "date_text", t.parts)


RELEVANCE = f"""(SELECT *, least(CAST(0.5 AS DOUBLE) + CASE WHEN d IS NOT NULL THEN CAST(0.2 AS DOUBLE) ELSE 0 END
    + CAST(0.1 AS DOUBLE) * len(topics) + CASE WHEN place IS NOT NULL THEN CAST(0.1 AS DOUBLE) ELSE 0 END, 1) AS r FROM
    (SELECT event_id, {B_START} AS d, {TOPICS} AS topics, {EVENT_PLACE} AS place FROM {EVENT}))"""


@query(
    "T16_event_relevance",
    f"""SELECT event_id, round(r, 2) AS relevance_score, CASE WHEN r > CAST(0.7 AS DOUBLE) THEN 'high'
    WHEN r > 0.5 THEN 'medium' ELSE 'low' END AS strategic_importance FROM {RELEVANCE}""",
)
def _(t):
    score = T.relevance(F.col("date_start"), T.event_topics(F.col("low")), T.event_place(F.col("block_text")))
    df = T.with_event_dates(event(t), "block_text").select("event_id", score.alias("r"))
    return df.select(
        "event_id", F.round("r", 2).alias("relevance_score"), T.strategic_importance(F.col("r")).alias("strategic_importance")
    )


VIRTUAL = S.any_word("lower(block_text)", rules.VIRTUAL_WORDS)


@query("T17_is_virtual", f"SELECT event_id, {VIRTUAL} AS is_virtual FROM {{blurbs}}")
def _(t):
    return t("blurbs").select("event_id", T.is_virtual(F.lower("block_text")).alias("is_virtual"))


TAGGED_EVENTS = f"""SELECT e.title, e.url, {EVENT_TYPE} AS event_type, '' AS description, {B_START} AS date_start, {B_END} AS date_end,
    left(block_text, 100) AS date_raw, {EVENT_PLACE} AS location, {VIRTUAL} AS is_virtual,
    array_to_string({TOPICS}, '|') AS key_topics, {makers()} AS participating_manufacturers,
    round(r, 2) AS relevance_score, CASE WHEN r > CAST(0.7 AS DOUBLE) THEN 'high' WHEN r > 0.5 THEN 'medium' ELSE 'low' END
    AS strategic_importance, 'events_page' AS source, TIMESTAMP '2026-01-01 00:00:00' AS scraped_at
    FROM {EVENT} e JOIN (SELECT event_id, r FROM {RELEVANCE}) USING (event_id)"""


@query("T17_tag_events", TAGGED_EVENTS)
def _(t):
    df = news.tag_events(t("blurbs"), AS_OF, raw_chars=100, parts=t.parts)
    lists = ["key_topics", "participating_manufacturers"]
    return df.select(*[joined(c).alias(c) if c in lists else F.col(c) for c in df.columns])


# --- questions and answers ------------------------------------------------------------------

WORDS = "[" + ", ".join(lit(w) for w in rules.SCOPE_WORDS) + "]"


@query(
    "T18_scope_words",
    f"""SELECT question_id, array_to_string(words, '|') AS words, len(words) > 0 AS in_scope FROM (SELECT question_id,
    list_filter({WORDS}, lambda w: contains(lower(question), w)) AS words FROM {{questions}})""",
)
def _(t):
    df = spread(t("questions"), t.parts).select("question_id", T.scope_words(F.lower("question")).alias("words"))
    return df.select("question_id", joined("words").alias("words"), (F.size("words") > 0).alias("in_scope"))


@query(
    "T18_scope_whole_words",
    f"""SELECT question_id, array_to_string(list_sort(list_filter({WORDS}, lambda w: contains(' ' ||
    regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || w || ' '))), '|') AS words FROM {{questions}}""",
)
def _(t):
    words = T.scope_words(F.lower("question"), word_boundary=True)
    return spread(t("questions"), t.parts).select("question_id", joined(words).alias("words"))


OUTSIDE = lit("(?i)" + "|".join(rules.OUTSIDE_KNOWLEDGE))
SENTENCES = "list_filter(list_transform(string_split(answer, '.'), lambda s: trim(s)), lambda s: s <> '')"


@query(
    "T19_drop_sentences",
    f"""SELECT answer_id, CASE WHEN good = '' THEN '' ELSE good || '.' END AS clean_text, removed FROM (SELECT answer_id,
    array_to_string(list_filter({SENTENCES}, lambda s: NOT regexp_matches(s, {OUTSIDE})), '. ') AS good,
    array_to_string(list_filter({SENTENCES}, lambda s: regexp_matches(s, {OUTSIDE})), '|') AS removed FROM {{answers}})""",
)
def _(t):
    df = T.with_sentences_dropped(t("answers"), "answer", parts=t.parts)
    return df.select("answer_id", "clean_text", joined("removed").alias("removed"))


ITEMS = "list_filter(list_transform(string_split(i, '.'), lambda s: trim(s)), lambda s: s <> '')"


@query(
    "T19_keep_items",
    f"""SELECT answer_id, array_to_string(list_transform(list_filter(string_split(answer, '. '),
      lambda i: len({ITEMS}) > 0 AND len(list_filter({ITEMS}, lambda s: regexp_matches(s, {OUTSIDE}))) = 0),
      lambda i: array_to_string({ITEMS}, '. ') || '.'), '|') AS items FROM {{answers}}""",
)
def _(t):
    items = T.keep_items(F.split("answer", r"\. "))
    return t("answers").select("answer_id", joined(items).alias("items"))


@query(
    "T20_article_record",
    """SELECT article_id, left(title, 100) AS headline, coalesce(nullif(summary, ''), 'No summary available') AS situation,
    'Neutral' AS sentiment, CAST(0.7 AS DOUBLE) AS confidence, 5 AS severity, 0 AS key_figures, false AS recall_related
    FROM (SELECT article_id, title, CASE WHEN article_id % 5 = 0 THEN '' ELSE summary END AS summary FROM {articles_raw})""",
)
def _(t):
    df = t("articles_raw").withColumn("summary", F.when(F.col("article_id") % 5 == 0, "").otherwise(F.col("summary")))
    df = df.select("article_id", T.article_record(F.col("title"), F.col("summary")).alias("r"))
    return df.select(
        "article_id", "r.executive_summary.headline", "r.executive_summary.situation", "r.classification.sentiment",
        "r.classification.confidence", "r.impact_assessment.severity",
        F.size("r.executive_summary.key_figures").alias("key_figures"), "r.impact_flags.recall_related",
    )


@query(
    "T21_event_record",
    """SELECT event_id, coalesce(nullif(description, ''), 'No description available') AS summary, 'Tier 2' AS tier,
    'Medium' AS importance_level, 'Unknown' AS attendance_recommendation, 0 AS participants FROM {trade_events}""",
)
def _(t):
    df = t("trade_events").select("event_id", T.event_record(F.col("description")).alias("r"))
    return df.select(
        "event_id", "r.analyst_brief.summary", "r.event_profile.tier", "r.strategic_importance.importance_level",
        "r.analyst_brief.attendance_recommendation", F.size("r.expected_coverage.participants").alias("participants"),
    )
