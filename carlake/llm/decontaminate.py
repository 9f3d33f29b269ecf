"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

An item is contaminating where a document holds CONTAINED of its five-word shingles or more. Items are
partitioned by the number of their shingles into powers of two. An item of a partition of up to u shingles is
sketched by its floor((1 - CONTAINED) * u) + 1 least MinHash values. A document that holds enough of the item
lacks at most floor((1 - CONTAINED) * n) of its shingles, so at least one value of the sketch is among the
document's, however long it is: the search loses no document. Candidates are verified by the shingles
themselves.

Items are taken in blocks of BLOCK_SHINGLES shingles, the size bound of what the driver holds and each task is sent;
documents are read once for each block, in a pass of its own, and never shuffled, so a passage that a third of them hold
costs no more than another.

Words are runs of letters and digits, in lower case. Edge cases: an item of fewer than five words has one shingle,
all its words; one without words is in no document; a null text has no shingles; repeated documents and items give a
row each; empty tables give no rows; extra columns are not looked at.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carlake.llm.common import WordHashes, sequence_hashes, whole_row, written

SHINGLE = 5
CONTAINED = Fraction(8, 10)
BLOCK_SHINGLES = 400_000  # shingles of one block of items: some 60 MB in a task
BASE = 0xA24BAED4963EE407
WORD = re.compile(r"[^\W_]+")
WORDS = WordHashes()


def words_in(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def shingles_of(words: list[str], n: int = SHINGLE) -> set[str]:
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


def shingle_hashes(words: list[str], n: int) -> np.ndarray:
    """The MinHash value of every run of n words."""
    return sequence_hashes(WORDS.of(words), n, BASE)


def sketch_size(n_shingles: int) -> int:
    """Least values kept of an item, by the upper bound of its size partition."""
    upper = 1 << (n_shingles - 1).bit_length()
    return int((1 - CONTAINED) * upper) + 1


class ItemBlock:
    """Sketches and shingles of some items, by shingle length (shorter than five words only for shorter items)."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items: list[tuple[int, frozenset[str]]] = []
        postings: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            words = words_in(text)
            if not words:
                continue
            n = min(SHINGLE, len(words))
            own = frozenset(shingles_of(words, n))
            values = np.unique(shingle_hashes(words, n))
            for value in values[: sketch_size(len(own))].tolist():
                postings[n][value].append(len(self.items))
            self.items.append((item_id, own))
        self.postings = {n: dict(p) for n, p in postings.items()}
        self.values = {n: np.array(sorted(p), np.uint64) for n, p in self.postings.items()}

    def matches(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, shared shingles, shingles of the item) of the items that the text contains."""
        words, found = words_in(text), []
        for n, values in self.values.items():
            hashes = shingle_hashes(words, n)
            at = np.searchsorted(values, hashes)
            met = np.unique(hashes[values[np.minimum(at, len(values) - 1)] == hashes]) if len(hashes) else hashes
            if not len(met):
                continue
            candidates = {i for value in met.tolist() for i in self.postings[n][value]}
            held = shingles_of(words, n)
            for i in sorted(candidates):
                item_id, own = self.items[i]
                shared = len(own & held)
                if shared * CONTAINED.denominator >= len(own) * CONTAINED.numerator:
                    found.append((item_id, shared, len(own)))
        return found


def item_blocks(benchmark: DataFrame, block_shingles: int = BLOCK_SHINGLES) -> Iterator[ItemBlock]:
    """Items in blocks of at most block_shingles shingles (an item by itself may hold more)."""
    held: list[tuple[int, str]] = []
    size = 0
    for row in benchmark.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        more = len(words_in(row["text"]))
        if held and size + more > block_shingles:
            yield ItemBlock(held)
            held, size = [], 0
        held.append((row["item_id"], row["text"]))
        size += more
    if held:
        yield ItemBlock(held)


def _following(blocks: Iterator[ItemBlock]) -> Iterator[tuple[ItemBlock, bool]]:
    """Every block, and whether another one follows; two blocks are held at most."""
    held = next(blocks, None)
    while held is not None:
        after = next(blocks, None)
        yield held, after is not None
        held = after


PAIRS = "doc_id long, item_id long, n_shared long, n_shingles long"


def contaminated_pairs(documents: DataFrame, benchmark: DataFrame, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles and containment of each item in each document that contains it.

    A pass over the documents for each block of items, with one worker a task and one block in it. With several
    blocks each pass is written, so neither the driver nor an executor ever holds the blocks of a large benchmark."""
    spark = documents.sparkSession
    rows, parts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), []
    for block, more in _following(item_blocks(benchmark, block_shingles)):
        sent = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = [(d, *m) for d, t in zip(batch["doc_id"], batch["text"]) for m in sent.value.matches(t)]
                made = pd.DataFrame(found, columns=["doc_id", "item_id", "n_shared", "n_shingles"])
                yield made.astype({"doc_id": "Int64", "item_id": "Int64"})

        part = rows.mapInPandas(search, PAIRS)
        parts.append(written(part, "pairs") if more or parts else part)
    pairs = reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], PAIRS)
    return pairs.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def clean_documents(documents: DataFrame, benchmark: DataFrame, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """The documents that contain no item, with all their columns; each block of items reads what those before it left."""
    for block, more in _following(item_blocks(benchmark, block_shingles)):
        rows = documents.select(whole_row(documents).alias("r"))
        documents = rows.where(_is_clean(F.col("r.text"), block)).select("r.*")
        documents = written(documents, "clean_documents") if more else documents
    return documents


def _is_clean(text: Column, block: ItemBlock) -> Column:
    sent = SparkSession.active().sparkContext.broadcast(block)

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([not sent.value.matches(t) for t in texts], dtype=bool)

    return run(text)
