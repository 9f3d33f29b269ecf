"""Quality rules as a short-circuit cascade.

Each rule's cost and rejection rate is measured on a sample of the documents that pass the base, inside Spark tasks; the
rules then run in the order of rejections per second, and the first that rejects a document ends its
cascade. A document is kept if no rule rejects it, so the order changes the time but never the verdict.

Edge cases: a null or empty text has no words, fails the base and is not kept; repeated rows are judged
each; an empty table gives no rows; columns of the input are carried along untouched.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from copy import copy
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carlake.llm.common import words_of

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
SAMPLE_ROWS = 400  # documents on which cost and selectivity are measured
SAMPLE_SEED = 7
# thresholds of the cascade's rules
SYMBOLS_PER_WORD = 1
MAX_WORD_CHARS = 20
LETTER_PERCENT = 40
TOP_WORD_PERCENT = 30
CONTROL_PERCENT = 1
CONTROLS = "".join(map(chr, [*range(0, 9), *range(14, 32)]))


class Text:
    """What rules look at; each part is computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return words_of(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeat_words(self.words)

    @cached_property
    def n_letters(self) -> int:
        return sum(map(str.isalpha, self.text))

    @cached_property
    def top_word(self) -> int:
        return Counter(self.words).most_common(1)[0][1] if self.words else 0

    @property
    def counts(self) -> tuple[int, int, int, int, int]:
        return self.n_words, self.word_chars, self.n_symbols, self.n_dup_lines, self.n_repeat_words

    @cached_property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > 50 * self.n_words


def repeat_words(words: list[bytes]) -> int:
    """Words covered by a three-word window that occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(index) + ids[1:]
    if len(index) >= 2_000_000:  # three ids no longer fit 63 bits; number the pairs first
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(index) + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    covered = np.zeros(n, bool)
    for at in (order[1:][same], order[:-1][same]):
        for k in range(3):
            covered[at + k] = True
    return int(covered.sum())


Rule = Callable[[Text], bool]
RULES: dict[str, Rule] = {
    "symbols": lambda t: t.n_symbols > SYMBOLS_PER_WORD * t.n_words,
    "repeated_lines": lambda t: 2 * t.n_dup_lines > len(t.lines),
    "long_words": lambda t: t.word_chars > MAX_WORD_CHARS * t.n_words,
    "few_letters": lambda t: 100 * t.n_letters < LETTER_PERCENT * t.word_chars,
    "one_word": lambda t: 100 * t.top_word > TOP_WORD_PERCENT * t.n_words,
    "control_characters": lambda t: 100 * sum(map(t.text.count, CONTROLS)) > CONTROL_PERCENT * len(t.text),
}


def measure(documents: DataFrame, rules: dict[str, Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple]:
    """(rule, seconds, rejections) over those that pass the base of about sample_rows documents, drawn at random with a seed.

    Rules are timed as the cascade runs them: the base counts are there already, and rejected documents never
    come. What one rule computes is not lent to the next, so that the order of timing does not count."""
    every = max(1, documents.count() // sample_rows)
    sample = documents.select("text").where(F.rand(SAMPLE_SEED) * every < 1)

    def timed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spent, hits = Counter(), Counter()
        for batch in batches:
            for text in batch["text"]:
                base = Text(text)
                base.counts  # noqa: B018  the cascade has them before its first rule
                if base.base_failed:
                    continue
                for name, rule in rules.items():
                    look = copy(base)
                    began = time.perf_counter()
                    hits[name] += bool(rule(look))
                    spent[name] += time.perf_counter() - began
        yield pd.DataFrame([(n, spent[n], hits[n]) for n in rules], columns=["rule", "seconds", "hits"])

    found = sample.mapInPandas(timed, "rule string, seconds double, hits long")
    return [tuple(r) for r in found.groupBy("rule").agg(F.sum("seconds"), F.sum("hits")).collect()]


def cascade_order(measured: list[tuple], rules: dict[str, Rule] = RULES) -> list[str]:
    """Rules by rejections per second, best first; unmeasured ones keep their place behind."""
    rate = {name: (hits or 0) / max(seconds or 0, 1e-9) for name, seconds, hits in measured}
    return sorted(rules, key=lambda n: -rate.get(n, 0))


def cascade(text: Column, order: list[str], rules: dict[str, Rule] = RULES) -> Column:
    """A struct of the base counts, the verdict, the rule that rejected first and the rules run."""
    kind = (
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
        "kept boolean, rejected_by string, n_rules_run int"
    )

    def judge(t: Text) -> tuple:
        counts = (*t.counts, t.base_failed)
        if t.base_failed:
            return (*counts, False, "base", 0)
        for k, name in enumerate(order):
            if rules[name](t):
                return (*counts, False, name, k + 1)
        return (*counts, True, None, len(order))

    names = [x.split()[0] for x in kind.split(", ")]

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([judge(Text(t)) for t in batch], columns=names)

    return run(text)


def judge_quality(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id with the counts, base_failed, kept, rejected_by and n_rules_run of each document."""
    order = cascade_order(measure(documents, RULES, sample_rows))
    judged = documents.select("doc_id", cascade(F.col("text"), order).alias("judged"))
    return judged.select("doc_id", "judged.*")
