"""Text rules as column expressions. ``low`` arguments take lower-cased text."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache, reduce
from hashlib import md5
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from carlake import rules
from carlake.functions.derived import any_of, first_match
from carlake.session import spread

# Regular expressions see Unicode letters, digits and spaces, and only \n ends a line.
UNICODE = "(?U)"
UNICODE_ANY_CASE = "(?iU)"
WORD = r"[^\x20\x09-\x0D]+"  # maximal runs without ASCII blanks
# Beginnings of patterns, and the same matches with less trying: the letter is looked at before the word boundary, and
# a leading word, which a blank or stop must follow, is tried from its first letter and as a whole only.
QUICK = {
    r"\b([A-Z]": r"(?=[A-Z])\b([A-Z]",
    r"\b(Model": r"(?=M)\b(Model",
    r"\b(20": r"(?=20)\b(20",
    r"(\w+)\.?\s+": r"(?<!\w)(\w++)\.?\s+",
}


def quick(pattern: str) -> str:
    slow = next((head for head in QUICK if pattern.startswith(head)), "")
    return QUICK.get(slow, "") + pattern[len(slow) :]


def has_any(low: Column, words: Sequence[str]) -> Column:
    return any_of([low.contains(w) for w in words])


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once per row. A lambda over an array would compute an
    expression from outside again for each element."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _weight_sum(low: Column, groups: Sequence[tuple[int, Sequence[str]]]) -> Column:
    terms = [F.when(low.contains(w), weight).otherwise(0) for weight, words in groups for w in words]
    return reduce(lambda a, b: a + b, terms)


# --- complaint sentiment ---------------------------------------------------


def tokens(c: Column) -> Column:
    """Lower-case words: runs of letters and apostrophes."""
    return F.array_remove(F.split(F.lower(c), r"[^a-z']+"), "")


def count_terms(toks: Column, terms: Sequence[str]) -> Column:
    return F.size(F.filter(toks, lambda t: t.isin(list(terms))))


def _signed_weights(toks: Column, lexicon: dict[str, int], negators: Sequence[str]) -> Column:
    weights = F.create_map(*[F.lit(x) for x in chain.from_iterable(lexicon.items())])

    def negated(i: Column) -> Column:
        before = [F.coalesce(F.get(toks, i - k).isin(list(negators)), F.lit(False)) for k in (1, 2)]
        return before[0] | before[1]

    def weigh(token: Column, i: Column) -> Column:
        # most words have no weight: a hash lookup sorts them out before the map is searched
        weight = F.element_at(weights, token)
        return F.when(~token.isin(list(lexicon)), 0).when(negated(i), -weight).otherwise(weight)

    return F.transform(toks, weigh)


def with_sentiment(
    df: DataFrame,
    text: str,
    lexicon: dict[str, int] | None = None,
    negators: Sequence[str] = rules.NEGATORS,
    safety_words: Sequence[str] = rules.SAFETY_WORDS,
    parts: int | None = None,
) -> DataFrame:
    """Adds score, label, confidence, negation count and safety-word count of a text column.

    A term's weight changes sign when one of the two words before it is a negator. With ``p`` and ``n``
    the sums of positive and negative weight, score = (p-n)/(p+n) and confidence = (p+n)/(p+n+3).
    Tokens and weights are separate projections so that each is computed once per row."""
    lexicon = lexicon or rules.lexicon()
    kept = list(df.columns)
    df = spread(df, parts).select("*", tokens(F.col(text)).alias("_tokens"))
    df = df.select("*", _signed_weights(F.col("_tokens"), lexicon, negators).alias("_weights"))

    def total(sign: int) -> Column:
        return F.aggregate("_weights", F.lit(0), lambda acc, w: acc + F.greatest(F.lit(0), w * sign))

    df = df.select("*", total(1).alias("_p"), total(-1).alias("_n"))
    p, n = F.col("_p"), F.col("_n")
    score = F.when(p.isNotNull(), F.coalesce(F.try_divide(p - n, p + n), F.lit(0.0)))
    return df.select(
        *kept,
        score.alias("sentiment_score"),
        first_match([(p > n, "positive"), (p < n, "negative"), (p == n, "neutral")], F.lit(None)).alias(
            "sentiment_label"
        ),
        ((p + n) / (p + n + 3)).alias("sentiment_confidence"),
        count_terms(F.col("_tokens"), negators).alias("negation_count"),
        count_terms(F.col("_tokens"), safety_words).alias("safety_keyword_count"),
    )


@lru_cache(maxsize=1 << 16)
def _word_hash(word: bytes) -> int:
    """The first eight hexadecimal digits of a word's MD5, as a number."""
    return int.from_bytes(md5(word, usedforsecurity=False).digest()[:4], "big")


BAG_ROWS = 128  # rows whose words a task holds at once


def _bags(texts: pa.Array, dim: int) -> pa.Array:
    """Unit-length counts of the words of each text by bucket, as lists of ``dim`` floats."""
    bags = np.zeros((len(texts), dim), np.float32)
    for start in range(0, len(texts), BAG_ROWS):
        # blanks of bytes are just the six that WORD leaves out
        words = [text.split() for text in texts.slice(start, BAG_ROWS).to_pylist()]
        sizes = [len(w) for w in words]
        hashes = np.fromiter(map(_word_hash, chain.from_iterable(words)), np.int64, sum(sizes))
        cells = np.repeat(np.arange(len(words)) * dim, sizes) + hashes % dim
        counts = np.bincount(cells, minlength=len(words) * dim).reshape(len(words), dim)
        length = np.sqrt((counts * counts).sum(axis=1))
        bags[start : start + BAG_ROWS] = counts / np.maximum(length, 1.0)[:, None]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * dim, pa.int32()), pa.array(bags.ravel()))


def embed_text(df: DataFrame, text: str, dim: int = 768, out: str = "embedding", parts: int | None = None) -> DataFrame:
    """A unit-length hashed bag of lower-cased words per row; it stands in for a trained encoder.

    A word falls on the place below ``dim`` that the first eight hexadecimal digits of its MD5 give, modulo ``dim``.
    Any engine with MD5 gives the same vector. A text without words, or NULL, is the zero vector."""

    def bags(texts: pa.Array) -> pa.Array:
        return _bags(texts, dim)

    embed = F.arrow_udf(bags, ArrayType(FloatType(), containsNull=False))
    low = F.lower(F.coalesce(F.col(text), F.lit(""))).cast("binary")
    return spread(df, parts).withColumn(out, embed(low))


# --- news --------------------------------------------------------------------


def news_sentiment(low: Column) -> Column:
    lead = _weight_sum(low, rules.POSITIVE_WORDS) - _weight_sum(low, rules.NEGATIVE_WORDS)
    return first_match([(lead < -1, "negative"), (lead > 1, "positive")], F.when(low.isNotNull(), "neutral"))


def news_category(low: Column) -> Column:
    cases = [(has_any(low, words), name) for name, words in rules.NEWS_CATEGORIES]
    return first_match(cases, F.when(low.isNotNull(), "general"))


def is_breaking(low: Column) -> Column:
    return has_any(low, rules.BREAKING_WORDS)


def is_safety_critical(low: Column) -> Column:
    return has_any(low, rules.SAFETY_CRITICAL_WORDS)


def importance(low: Column, category: Column, breaking: Column) -> Column:
    points = (
        F.when(category.isin(rules.WEIGHTY_CATEGORIES), 2).otherwise(0)
        + F.when(has_any(low, rules.URGENT_WORDS), 2).otherwise(0)
        + F.when(has_any(low, rules.IMPACT_WORDS), 1).otherwise(0)
        + F.when(breaking, 1).otherwise(0)
    )
    return F.least(points + 5, F.lit(10))


def _all(c: Column, pattern: str, flags: str = UNICODE) -> Column:
    """First group of every match."""
    return F.regexp_extract_all(c, F.lit(flags + quick(pattern)), F.lit(1))


def _without(found: Column, stop: Sequence[str]) -> Column:
    return F.filter(found, lambda m: ~m.isin(list(stop)))


def _first_sorted(lists: Sequence[Column], n: int) -> Column:
    found = F.sort_array(F.array_distinct(F.concat(*lists)))
    return found if n is None else F.slice(found, 1, n)


def extract_makers(c: Column, n: int | None = None) -> Column:
    """Company names by context, sorted; the first ``n`` where it is given."""
    stop = rules.MAKER_STOP_WORDS
    acronyms = F.when(
        c.rlike(UNICODE_ANY_CASE + rules.VEHICLE_CONTEXT),
        _without(_all(c, rules.MAKER_ACRONYM), rules.ACRONYM_STOP_WORDS),
    ).otherwise(F.array().cast("array<string>"))
    return _first_sorted(
        [
            _all(c, rules.MAKER_COMPANY),
            _without(_all(c, rules.MAKER_VERB), stop),
            _without(_all(c, rules.MAKER_TITLE, UNICODE_ANY_CASE), stop),
            F.filter(_without(_all(c, rules.MAKER_PLACE), stop), lambda m: F.length(m) > 2),
            _without(_all(c, rules.MAKER_OWNER), stop),
            acronyms,
        ],
        n,
    )


def extract_models(c: Column, n: int | None = None) -> Column:
    hyphened = F.filter(
        _all(c, rules.MODEL_HYPHEN),
        lambda m: ~any_of([F.lower(m).startswith(p) for p in rules.MODEL_NOT_PREFIXES]),
    )
    return _first_sorted([_all(c, p) for p in rules.MODEL_PATTERNS] + [hyphened], n)


def extract_people(c: Column, n: int | None = None) -> Column:
    speakers = F.filter(
        _all(c, rules.PERSON_SPEAKS),
        lambda m: ~F.element_at(F.split(m, r"\s+"), 1).isin(rules.PERSON_NOT_FIRST),
    )
    # a title word is much cheaper to look for than a pair of names before it
    titled = F.when(
        c.rlike(UNICODE_ANY_CASE + rules.PERSON_TITLE_WORD), _all(c, rules.PERSON_APPOSITION, UNICODE_ANY_CASE)
    ).otherwise(F.array().cast("array<string>"))
    return _first_sorted([_all(c, rules.PERSON_TITLED), titled, speakers], n)


def extract_places(c: Column, n: int | None = None) -> Column:
    return _first_sorted([_all(c, p) for p in rules.PLACE_PATTERNS], n)


# --- trade events --------------------------------------------------------------


def event_place(c: Column) -> Column:
    """The first place named by the first pattern that matches at all."""
    found = [F.nullif(F.regexp_extract(c, UNICODE + p, 1), F.lit("")) for p in rules.EVENT_PLACE_PATTERNS]
    return F.coalesce(*found)


def event_type(low: Column) -> Column:
    cases = [(has_any(low, words), name) for name, words in rules.EVENT_TYPES]
    return first_match(cases, F.when(low.isNotNull(), "event"))


def event_topics(low: Column) -> Column:
    return F.array_compact(
        F.array(*[F.when(has_any(low, words), F.lit(name)) for name, words in rules.EVENT_TOPICS])
    )


def _month_number(name: Column) -> Column:
    months = {}
    for number, month in enumerate(rules.MONTHS, 1):
        months[month] = months[month[:3]] = f"{number:02d}"
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(months.items())]), name)


def _iso_date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, month, F.lpad(day, 2, "0")), "yyyy-MM-dd")


def with_event_dates(df: DataFrame, text: str, parts: int | None = None) -> DataFrame:
    """Adds date_start and date_end from a date range, else a single date, else a bare year; else NULL.

    Only the first match of a pattern counts; a month name outside the list falls through. Every pattern
    runs once over the text; its parts are then taken from the short match."""
    kept = df.columns
    body = F.regexp_replace(
        F.regexp_replace(text, UNICODE + r"^\s+|\s+$", ""), UNICODE_ANY_CASE + rules.DATE_PREFIX, ""
    )
    df = spread(df, parts).select("*", body.alias("_body"))

    def found(pattern: str, group: int) -> Column:
        return F.regexp_extract("_body", UNICODE + quick(pattern), group)

    df = df.select(
        "*", found(rules.DATE_RANGE, 0).alias("_span"), found(rules.DATE_SINGLE, 0).alias("_single"),
        found(rules.DATE_YEAR, 1).alias("_year"),
    )

    def part(match: str, pattern: str, group: int) -> Column:
        return F.regexp_extract(match, UNICODE + quick(pattern), group)

    df = df.select(
        "*", _month_number(part("_span", rules.DATE_RANGE, 1)).alias("_span_month"),
        _month_number(part("_single", rules.DATE_SINGLE, 1)).alias("_single_month"),
    )
    span_year, span_month = part("_span", rules.DATE_RANGE, 4), F.col("_span_month")
    in_span = span_month.isNotNull()
    start = (
        F.when(in_span, _iso_date(span_year, span_month, part("_span", rules.DATE_RANGE, 2)))
        .when(
            F.col("_single_month").isNotNull(),
            _iso_date(
                part("_single", rules.DATE_SINGLE, 3), F.col("_single_month"), part("_single", rules.DATE_SINGLE, 2)
            ),
        )
        .when(F.col("_year") != "", _iso_date(F.col("_year"), F.lit("01"), F.lit("01")))
    )
    end = F.when(in_span, _iso_date(span_year, span_month, part("_span", rules.DATE_RANGE, 3)))
    return df.select(*kept, start.alias("date_start"), end.alias("date_end"))


def relevance(start: Column, topics: Column, place: Column) -> Column:
    """Unrounded relevance in double arithmetic."""
    score = F.lit(0.5) + F.when(start.isNotNull(), F.lit(0.2)).otherwise(F.lit(0.0))
    score = score + F.lit(0.1) * F.coalesce(F.size(topics), F.lit(0))
    score = score + F.when(place.isNotNull(), F.lit(0.1)).otherwise(F.lit(0.0))
    return F.least(score, F.lit(1.0))


def strategic_importance(score: Column) -> Column:
    return first_match([(score > 0.7, "high"), (score > 0.5, "medium")], "low")


def is_virtual(low: Column) -> Column:
    return has_any(low, rules.VIRTUAL_WORDS)


# --- questions and answers -------------------------------------------------------


def scope_words(low: Column, words: Sequence[str] = rules.SCOPE_WORDS, word_boundary: bool = False) -> Column:
    """Domain words in a question, in list order; by default as substrings, optionally as whole words.

    The list is one array literal that is filtered per row: a chain of conditions of this length would
    make generated code too large to be compiled."""
    if not word_boundary:
        listed = F.array(*[F.lit(w) for w in words])
        return bind(low, lambda text: F.filter(listed, lambda w: text.contains(w)))
    single = [w for w in words if " " not in w]
    parts = F.split(low, "[^a-z0-9]+")
    joined = F.concat(F.lit(" "), F.array_join(parts, " "), F.lit(" "))
    phrases = [F.when(joined.contains(f" {w} "), F.lit(w)) for w in words if " " in w]
    found = F.concat(F.array_intersect(F.array(*[F.lit(w) for w in single]), parts), F.array_compact(F.array(*phrases)))
    return F.array_sort(found)


def split_sentences(c: Column) -> Column:
    stripped = F.transform(F.split(c, r"\."), lambda s: F.regexp_replace(s, UNICODE + r"^\s+|\s+$", ""))
    return F.filter(stripped, lambda s: s != "")


def with_sentences_dropped(
    df: DataFrame, text: str, patterns: Sequence[str] = rules.OUTSIDE_KNOWLEDGE, parts: int | None = None
) -> DataFrame:
    """Adds ``clean_text`` without the sentences that match a pattern, and the list ``removed``."""
    joined = UNICODE_ANY_CASE + "|".join(patterns)
    kept = df.columns
    marked = F.transform(
        split_sentences(F.col(text)), lambda s: F.struct(s.alias("text"), s.rlike(joined).alias("bad"))
    )
    df = spread(df, parts).select("*", marked.alias("_sentences"))
    good = F.array_join(F.filter("_sentences", lambda s: ~s["bad"])["text"], ". ")
    df = df.select("*", good.alias("_good"))
    return df.select(
        *kept,
        F.when((F.col("_good") != "") & ~F.col("_good").endswith("."), F.concat("_good", F.lit(".")))
        .otherwise(F.col("_good"))
        .alias("clean_text"),
        F.filter("_sentences", lambda s: s["bad"])["text"].alias("removed"),
    )


def keep_items(items: Column, patterns: Sequence[str] = rules.OUTSIDE_KNOWLEDGE) -> Column:
    """List items in which no sentence matches a pattern and some text is left, ended with a full stop."""
    joined = UNICODE_ANY_CASE + "|".join(patterns)
    as_sentences = F.transform(items, split_sentences)
    clean = F.filter(as_sentences, lambda i: (F.size(i) > 0) & ~F.exists(i, lambda s: s.rlike(joined)))
    return F.transform(clean, lambda i: F.concat(F.array_join(i, ". "), F.lit(".")))


# --- default analysis records (fixed values) -----------------------------------------


def _empty() -> Column:
    return F.array().cast("array<string>")


def _entities() -> Column:
    names = ["manufacturers", "suppliers", "executives", "organizations", "regions"]
    return F.struct(*[_empty().alias(n) for n in names])


def article_record(title: Column, summary: Column) -> Column:
    """The analysis record an article gets when nothing else is known about it."""
    flags = [
        "breaking_news", "recall_related", "affects_guidance", "supply_chain_disruption", "regulatory_action",
        "labor_action", "merger_acquisition",
    ]
    return F.struct(
        _entities().alias("key_entities"),
        F.struct(
            F.lit("General").alias("category"),
            F.lit("").alias("sub_category"),
            F.lit("Neutral").alias("sentiment"),
            F.lit(0.7).alias("confidence"),
        ).alias("classification"),
        F.struct(
            F.lit(5).alias("severity"),
            F.lit("Near-term").alias("time_horizon"),
            _empty().alias("affected_segments"),
            F.struct(
                _empty().alias("affected_tickers"),
                F.lit("Neutral").alias("direction"),
                F.lit("Minimal").alias("magnitude"),
            ).alias("stock_impact"),
        ).alias("impact_assessment"),
        F.struct(*[F.lit(False).alias(f) for f in flags]).alias("impact_flags"),
        F.struct(
            F.substring(title, 1, 100).alias("headline"),
            F.coalesce(F.nullif(summary, F.lit("")), F.lit("No summary available")).alias("situation"),
            F.lit("").alias("implications"),
            _empty().alias("key_figures"),
            _empty().alias("action_items"),
        ).alias("executive_summary"),
        F.struct(
            F.lit("").alias("historical_precedent"),
            F.lit("").alias("competitive_dynamics"),
        ).alias("related_context"),
    )


def event_record(description: Column) -> Column:
    """The analysis record of a trade event about which nothing else is known."""
    return F.struct(
        _entities().alias("key_entities"),
        F.struct(
            F.lit("Conference").alias("event_type"),
            F.lit("Tier 2").alias("tier"),
            F.lit("Industry Professionals").alias("primary_audience"),
        ).alias("event_profile"),
        F.struct(
            F.lit(0.5).alias("relevance_score"),
            F.lit("Medium").alias("importance_level"),
            F.lit("").alias("rationale"),
        ).alias("strategic_importance"),
        F.struct(
            _empty().alias("participants"),
            _empty().alias("key_topics"),
            _empty().alias("potential_market_movers"),
        ).alias("expected_coverage"),
        F.struct(
            F.coalesce(F.nullif(description, F.lit("")), F.lit("No description available")).alias("summary"),
            _empty().alias("watch_items"),
            F.lit("").alias("historical_context"),
            F.lit("Unknown").alias("attendance_recommendation"),
        ).alias("analyst_brief"),
        F.struct(
            F.lit("Unknown").alias("registration_status"),
            F.lit("Unknown").alias("media_coverage"),
            _empty().alias("key_dates"),
        ).alias("logistics"),
    )
