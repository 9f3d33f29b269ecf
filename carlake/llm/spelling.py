"""Spelling variants: words one code point apart, grouped under their most frequent form.

Counting. Every task counts the words of whole texts in a table of bounded size and hands it on; the counts are
then summed by word.

Search. A pair that differs by one inserted, deleted or replaced code point shares its first or its last part: with b
the length of its shorter word, the first b/2 code points or the last b - b/2. So each word joins four groups (two
lengths b, two parts), and only words of a group are compared, by a bit-sliced index of the group: for every position
and letter a bitset over its words. A word runs over the index once; word-parallel recurrences keep the set of words
that equal it so far (no error) and the sets with one error so far, at the same position (replaced), one further
(inserted) and one back (deleted). Bits stand in order of falling counts, so the lowest bit of a result is the most
frequent near word and its population the number of near words. A pair that shares both parts counts in the first one only.

A group above BLOCK words is cut into blocks and every two blocks meet in a task of their own, so a task holds two
blocks; a group of g words is copied g / BLOCK times, which is felt from some hundred blocks (half a million words
that share half of their letters).

Forms. A word's form is its near word of the largest count (ties: smallest in code-point order) if that count is at
least RATIO times its own. Counts double along a chain of forms, so pointer jumping ends after a few rounds.

Edge cases: null and empty texts have no words; repeated rows count each time; a null doc_id stands as empty text
where a word is edited by its document; an empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carlake.llm.common import written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
MIN_CHARS = 5
MIN_COUNT = 3
RATIO = 2
BLOCK = 4096
COUNTED = 300_000  # words a task counts before it hands them on
LONG_TEXT = 1 << 22  # code points from which words are taken one by one instead of as a list
TYPO_EVERY = 97
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

Edit = Callable[[int | None, dict[str, int]], list[tuple[str, int]]]


def planted_typos(doc_id: int | None, counts: dict[str, int]) -> list[tuple[str, int]]:
    """Every 97th word of a document, by a checksum of both, loses one code point."""
    start = zlib.crc32(b"%s:" % (b"" if doc_id is None else b"%d" % doc_id))
    out = []
    for word, n in counts.items():
        h = zlib.crc32(word.encode(), start)
        if h % TYPO_EVERY == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        out.append((word, n))
    return out


def runs(text: str) -> Counter:
    low = text.translate(LOWER)
    return Counter(RUN.findall(low) if len(low) < LONG_TEXT else map(itemgetter(0), RUN.finditer(low)))


def word_counts(documents: DataFrame, edit: Edit | None = None, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough; ``edit`` may change a document's words before."""

    def table(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                if text.is_valid:
                    own = runs(text.as_py())
                    for word, n in edit(doc_id.as_py(), own) if edit else own.items():
                        if len(word) >= min_chars:
                            total[word] += n
                    if len(total) >= COUNTED:
                        yield table(total)
                        total = Counter()
        yield table(total)

    counted = documents.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class SlicedIndex:
    """Bitsets over words of two lengths, one for each position and letter; bits in order of falling counts."""

    def __init__(self, members: list[tuple[str, int]]) -> None:
        self.members = sorted(members, key=lambda m: (-m[1], m[0]))
        width = len(self.members) // 8 + 1
        letters: dict = defaultdict(lambda: bytearray(width))
        lengths: dict = defaultdict(lambda: bytearray(width))
        for i, (word, _) in enumerate(self.members):
            byte, bit = i >> 3, 1 << (i & 7)
            lengths[len(word)][byte] |= bit
            for at in enumerate(word):
                letters[at][byte] |= bit
        self.letters = {at: int.from_bytes(bits, "little") for at, bits in letters.items()}
        self.lengths = {n: int.from_bytes(bits, "little") for n, bits in lengths.items()}
        self.all = (1 << len(self.members)) - 1

    def near(self, word: str, shorter: int, apart: int = 0) -> int:
        """The words one error away from ``word``, as a bitset; pairs have a shorter word of ``shorter`` code points.

        With ``apart``, words that share the first so many code points are left out."""
        equal, replaced, inserted, deleted, shared = self.all, 0, 0, 0, 0
        get = self.letters.get
        for i, letter in enumerate(word):
            if i == apart:
                shared = equal
            here = get((i, letter), 0)
            inserted = (inserted | equal) & get((i + 1, letter), 0)
            deleted = deleted & get((i - 1, letter), 0) | equal
            replaced = replaced & here | equal & ~here
            equal &= here
        if len(word) == shorter:
            found = replaced & self.lengths.get(shorter, 0) | (inserted | equal) & self.lengths.get(shorter + 1, 0)
        else:
            found = deleted & self.lengths.get(shorter, 0)
        return found & ~shared if apart else found

    def first(self, found: int) -> tuple[str, int]:
        return self.members[(found & -found).bit_length() - 1]


def group_keys(word: Column, min_chars: int) -> Column:
    """The groups of a word: length of the shorter word of its pairs, which part is shared, and that part."""
    n = F.char_length(word)
    keys = []
    for less in (0, 1):
        shorter = n - less
        head = F.expr(f"(char_length(word) - {less}) div 2").cast("int")
        keys.append(F.struct(shorter.alias("shorter"), F.lit(True).alias("is_head"), word.substr(F.lit(1), head).alias("part")))
        tail = shorter - head
        keys.append(F.struct(shorter.alias("shorter"), F.lit(False).alias("is_head"), F.right(word, tail).alias("part")))
    return F.filter(F.array(*keys), lambda k: k["shorter"] >= min_chars)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, counts, forms, form_counts = [], [], [], []
        for shorter, is_head, cell, members in zip(*(batch.column(c) for c in ("shorter", "is_head", "cell", "members"))):
            b = shorter.as_py()
            blocks = defaultdict(list)
            own = members.values
            for word, n, block in zip(*(own.field(k).to_pylist() for k in range(3))):
                blocks[block].append((word, n))
            low, high = cell["low"].as_py(), cell["high"].as_py()
            for asking, asked in {(low, high), (high, low)}:
                if not blocks[asking] or not blocks[asked]:
                    continue
                index = SlicedIndex(blocks[asked])
                for word, _ in blocks[asking]:
                    if found := index.near(word, b, 0 if is_head.as_py() else b // 2):
                        form, n = index.first(found)
                        words.append(word)
                        counts.append(found.bit_count())
                        forms.append(form)
                        form_counts.append(n)
        yield pa.RecordBatch.from_pydict(
            {"word": pa.array(words, pa.string()), "n_near": pa.array(counts, pa.int64()), "form": pa.array(forms, pa.string()), "form_n": pa.array(form_counts, pa.int64())}
        )


def near_words(vocabulary: DataFrame, min_chars: int = MIN_CHARS, block: int = BLOCK) -> DataFrame:
    """(word, n_near, form, form_n): number of near words and the most frequent of them, for words that have any."""
    posts = vocabulary.select("word", "n", F.explode(group_keys(F.col("word"), min_chars)).alias("key"))
    sizes = posts.groupBy("key").agg(F.count("*").alias("size"))
    large = written(sizes.where(F.col("size") > block), "large_groups").withColumnRenamed("key", "large_key")
    parts = F.coalesce(F.ceil(F.col("size") / block), F.lit(1)).cast("int")
    at = posts.join(large, F.col("key") == F.col("large_key"), "left").select("key", "word", "n", parts.alias("parts"))
    own = F.pmod(F.xxhash64("word"), "parts").cast("int")
    met = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(own, k).alias("low"), F.greatest(own, k).alias("high"))
    )
    cells = at.select("key", F.struct("word", "n", own.alias("block")).alias("member"), F.explode(met).alias("cell"))
    groups = cells.groupBy("key", "cell").agg(F.collect_list("member").alias("members")).where(F.size("members") > 1)
    found = groups.select("key.shorter", "key.is_head", "cell", "members").mapInArrow(
        _search, "word string, n_near long, form string, form_n long"
    )
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last form of each word's chain, for words (word, form) that have one."""
    links = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = links.select(F.col("word").alias("at"), F.col("root").alias("further"))
        stepped = links.join(further, F.col("root") == F.col("at"), "left")
        links = written(
            stepped.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots"
        )
        if not links.where("moved").limit(1).count():
            return links.select("word", "root")


def spelling_groups(
    documents: DataFrame, edit: Edit | None = None, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, block: int = BLOCK
) -> DataFrame:
    """word, n, n_near, form, form_n and root for every word of the vocabulary."""
    vocabulary = written(word_counts(documents, edit, min_chars, min_count), "vocabulary")
    near = near_words(vocabulary, min_chars, block)
    is_form = F.col("form_n") >= RATIO * F.col("n")
    judged = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"),
    )
    judged = written(judged, "judged_words")
    last = roots(judged.where(F.col("form").isNotNull()))
    met = judged.join(last, "word", "left")
    return met.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
