"""SimHash near-duplicates, found through an inverted index of fingerprint bytes.

Two 64-bit fingerprints that differ in at most three bits differ in at most three of their eight bytes, so
they share at least five positional bytes. The index has one posting list per block of four positions and the
bytes there. The fourteen blocks are the Steiner system S(3,4,8): whatever three positions differ, one block
avoids them, so every linked pair meets in a list. (Lists of one byte hold a 256th of the corpus each, which
would make the work grow with its square.) Pairs that meet are counted: those sharing five positional bytes or
more are kept and verified by their differing bits.

Documents with equal fingerprints are one class. A list passes on a spanning forest of its links,
not its pairs; a list above LIST_ROWS is cut into parts and every two parts meet in a task of their own.

Edge cases: a text without words has fingerprint zero and is linked like any other; one of fewer than three
words has one shingle, the whole sequence; rows may repeat; a null doc_id never becomes a component id unless its
component has no other; an empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carlake.llm.common import whole_row, words_of, written
from carlake.llm.components import components

SHINGLE = 3
SEED = 42
BITS = 3  # fingerprints link at this many differing bits or fewer
SHARED_BYTES = 8 - BITS
LIST_ROWS = 512
STEP = 1 << 16  # shingles hashed at once


def blocks() -> list[tuple[int, ...]]:
    """Fourteen sets of four byte positions; any three positions are avoided by one of them.

    They are the weight-four words of the extended Hamming code: positions whose numbers cancel out."""
    return [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]


def fingerprint_of(text: str | None) -> int:
    """The 64-bit fingerprint of a text, as a signed number."""
    words = [w.lower() for w in words_of(text)]  # bytes.lower() changes A-Z only
    if not words:
        return 0
    if len(words) <= SHINGLE:
        shingles: list[bytes] = [b" ".join(words)]
    else:
        shingles = [b"%b %b %b" % x for x in zip(words, words[1:], words[2:])]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), STEP):
        part = shingles[at : at + STEP]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), ">u8", len(part))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles)).view(">i8")[0])


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([fingerprint_of(t) for t in batch], dtype="int64")


def fingerprint(text: Column) -> Column:
    return F.pandas_udf(_fingerprints, "long")(text)


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def posting_keys(fp: Column) -> Column:
    """The keys of the lists a fingerprint stands in: the number of the block above its four bytes."""
    keys = []
    for number, positions in enumerate(blocks()):
        key = F.lit(number).cast("long")
        for p in positions:
            byte = F.shiftrightunsigned(fp, 56 - 8 * p).bitwiseAND(F.lit(255))
            key = F.shiftleft(key, 8).bitwiseOR(byte)
        keys.append(key)
    return F.array(*keys)


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the same members as all links of the list do."""
    n = len(fps)
    apart = fps[:, None] ^ fps[None, :]
    shared = np.zeros((n, n), np.uint8)
    for k in range(8):
        shared += (apart >> np.uint64(8 * k)) & np.uint64(255) == 0
    near = (shared >= SHARED_BYTES) & (np.bitwise_count(apart) <= BITS)
    free, links = np.ones(n, bool), []
    for root in range(n):
        if not free[root]:
            continue
        free[root] = False
        stack = [root]
        while stack:
            at = stack.pop()
            found = np.flatnonzero(near[at] & free)
            free[found] = False
            stack.extend(found.tolist())
            links.extend((at, k) for k in found.tolist())
    return links


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [], []
        for members in batch.column("fps"):
            fps = np.unique(members.values.to_numpy())
            for i, k in forest(fps.view(np.uint64)):
                a.append(fps[i])
                b.append(fps[k])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_links(fingerprints: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that join all that are near, transitively."""
    posts = fingerprints.select("fp", F.explode(posting_keys(F.col("fp"))).alias("key"))
    sizes = posts.groupBy("key").agg(F.count("*").alias("n"))
    # few of the many lists: those above list_rows
    hot = written(sizes.where(F.col("n") > list_rows), "hot_lists").withColumnRenamed("key", "hot_key")
    parts = F.coalesce(F.ceil(F.col("n") / list_rows), F.lit(1)).cast("long")
    at = posts.join(hot, F.col("key") == F.col("hot_key"), "left").select("key", "fp", parts.alias("parts"))
    own = F.pmod(F.xxhash64("fp"), "parts")
    met = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("parts") - 1),
        lambda k: F.struct(F.least(own, k).alias("low"), F.greatest(own, k).alias("high")),
    )
    cells = at.select("key", "fp", F.explode(met).alias("cell"))
    lists = cells.groupBy("key", "cell").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return lists.select("fps").mapInArrow(_links, "a long, b long").distinct()


def near_duplicates(documents: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id, the smallest doc_id reachable over links."""
    prints = written(documents.select("doc_id", fingerprint(F.col("text")).alias("fp")), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    linked = components(near_links(classes, list_rows))
    # the least document of each component, for the classes that have a link
    joined = linked.join(classes, linked["node"] == classes["fp"]).select("node", "label", "least")
    joined = written(joined, "linked_classes")
    ids = written(joined.groupBy("label").agg(F.min("least").alias("component")), "component_ids")
    named = joined.join(ids, "label").select(F.col("node").alias("fp"), "component")
    of_class = classes.join(named, "fp", "left").select(
        F.col("fp").alias("class_fp"), F.coalesce("component", "least").alias("component_id")
    )
    of_class = written(of_class, "class_components")
    met = prints.join(of_class, F.col("fp") == F.col("class_fp"), "left")
    return met.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def keep_first(documents: DataFrame) -> DataFrame:
    """One document of each component: the row of its smallest doc_id, with all its columns.

    Rows of one doc_id stay or go together; of those with equal texts the one whose columns come first in order stays (null
    first; a column with a map by its JSON text); rows without an id stay."""
    found = near_duplicates(documents.select("doc_id", "text"))
    first = found.groupBy("component_id").agg(F.min("doc_id").alias("kept_id"))
    kept = written(first.where(F.col("kept_id").isNotNull()).select("kept_id").distinct(), "kept_documents")
    rows = documents.join(kept, documents["doc_id"] == kept["kept_id"], "left_semi")
    unnamed = documents.where(F.col("doc_id").isNull())
    others = [f"`{c.replace('`', '``')}`" for c, _ in documents.dtypes if c not in ("doc_id", "text")]
    kinds = [kind for c, kind in documents.dtypes if c not in ("doc_id", "text")]
    order = F.struct(F.lit(1).alias("one"), *[F.to_json(F.struct(c)) if "map<" in k else F.col(c) for c, k in zip(others, kinds)])
    least = rows.groupBy("doc_id", "text").agg(F.min_by(whole_row(documents), order).alias("r"))
    return least.select("r.*").union(unnamed)
