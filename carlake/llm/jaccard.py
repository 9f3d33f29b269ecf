"""Exact Jaccard join of documents on word n-grams, by parity sketches.

A document is its set of distinct shingles, told apart by 64-bit hashes. Equal sets are one class and are searched once.

Sketches. A shingle flips one bit of a sketch, so equal shingles cancel out and the Hamming distance of two sketches
never exceeds the size of the symmetric difference of their sets. Sets that link (similarity PERCENT) are at most d
apart, and d follows from their sizes; sizes are cut into bands of ratio (PERCENT/100)^3, and a band takes in, besides
its own sizes, the larger ones that may link with them.

Pigeonhole join. A band's sketch is cut into m = 2(d + 1) blocks of BLOCK_BITS bits. Linked sets agree in m - d blocks at
least, so under one order of all (block, value) pairs their first d + 1 ones share one. The order puts blocks
with many bits set first, as those hardly ever agree by chance. These d + 1 pairs are the keys of a set.

Verification. Sets that meet in a key are compared by a second parity sketch of about eight bits a shingle: each list passes on
a spanning forest of the pairs whose Hamming distance allows a link, not all pairs. Links of the forests are then verified
by the sets themselves. Where one fails, its list is searched again for all pairs of its members that are not yet
joined, and those are verified too: so no link between different sets is lost, and none is made up.

A key of more than LIST_ROWS sets is cut into parts and every two parts meet in a task of their own. A list of g sets
is copied g / LIST_ROWS times, which is felt from some hundred thousand near but different sets.

Edge cases: a text with fewer words than a shingle has one shingle, the whole sequence; a text without words, or null, has
none and links with nothing; rows may repeat; a null doc_id never becomes a component id unless its component has no
other; an empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carlake.llm.common import WordHashes, mix, sequence_hashes, words_of, written
from carlake.llm.components import components

SHINGLE = 3
PERCENT = 90
BLOCK_BITS = 4096  # of a block that is compared as a whole
LIST_ROWS = 2048
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
KEY_BITS = np.uint64((1 << 56) - 1)  # a key's upper byte is its band


def shingle_set(text: str | None, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = [w.lower() for w in words_of(text)]  # bytes.lower() changes A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    n = min(size, len(words))
    return np.unique(sequence_hashes(hashes.of(words), n, BASES[0] + 2 * n))


def set_key(items: np.ndarray) -> tuple[int, int]:
    """128 bits for a set."""
    with np.errstate(over="ignore"):
        return tuple(int(mix(items * np.uint64(b)).sum(dtype=np.uint64)) for b in BASES[1:])


def most_apart(sizes: int | np.ndarray, percent: int = PERCENT) -> int | np.ndarray:
    """The largest symmetric difference of linked sets whose sizes add up to ``sizes``."""
    return sizes - 2 * -(-percent * sizes // (100 + percent))


@cache
def bands(percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """(first size, last size it takes in, largest difference within) of each band, for sizes up to 2^40."""
    out, start = [], 1
    while start < 1 << 40:
        end = max(start + 1, start * 100**3 // percent**3)
        last = (end - 1) * 100 // percent
        out.append((start, last, most_apart(end - 1 + last, percent)))
        start = end
    return out


def bands_of(n: int, percent: int = PERCENT) -> list[int]:
    """The bands a set of n shingles joins; bands whose links are equal sets only are left out."""
    return [j for j, (first, last, d) in enumerate(bands(percent)) if first <= n <= last and d > 0]


def block_keys(items: np.ndarray, band: int, percent: int = PERCENT) -> np.ndarray:
    """The d + 1 keys of a set in a band."""
    d = bands(percent)[band][2]
    m = 2 * (d + 1)
    places, counts = np.unique(mix(items) % np.uint64(m * BLOCK_BITS), return_counts=True)
    odd = places[counts % 2 == 1]
    blocks = (odd // np.uint64(BLOCK_BITS)).astype(np.int64)
    bits = np.bincount(blocks, minlength=m)
    values = mix(np.arange(m, dtype=np.uint64) + np.uint64(BASES[1]))  # of a block without any bit
    if len(odd):
        firsts = np.flatnonzero(np.diff(blocks, prepend=-1))
        values[blocks[firsts]] = np.bitwise_xor.reduceat(mix(odd + np.uint64(BASES[2])), firsts)
    chosen = np.lexsort((values, -bits))[: d + 1]
    return (mix(values[chosen]) & KEY_BITS) | np.uint64(band << 56)


def sketch_bytes(band: int, percent: int = PERCENT) -> int:
    """A byte a shingle, in words of eight."""
    return -(-max(128, bands(percent)[band][1]) // 8) * 8


def parity_sketch(items: np.ndarray, band: int, percent: int = PERCENT) -> bytes:
    size = sketch_bytes(band, percent)
    with np.errstate(over="ignore"):
        at = mix(items ^ np.uint64(BASES[0])) % np.uint64(size * 8)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=size * 8) & 1).tobytes()


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64), pa.int64())


PRINTS = "doc_id long, n long, k1 long, k2 long, keys array<long>, sketches array<struct<band: int, bits: binary>>"


def _prints(size: int, percent: int):
    kind = pa.list_(pa.struct([("band", pa.int32()), ("bits", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                n, k1, k2, keys, sketches = [], [], [], [], []
                for text in part.column("text"):
                    items = shingle_set(text.as_py(), hashes, size)
                    own = bands_of(len(items), percent)
                    n.append(len(items))
                    a, b = set_key(items)
                    k1.append(a)
                    k2.append(b)
                    found = [block_keys(items, j, percent) for j in own]
                    keys.append(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))
                    sketches.append([{"band": j, "bits": parity_sketch(items, j, percent)} for j in own])
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), _signed(k1), _signed(k2), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, kind)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "k1", "k2", "keys", "sketches"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sets = [shingle_set(t.as_py(), hashes, size) for t in batch.column("text").slice(at, 500)]
                pairs = [set_key(s) for s in sets]
                items = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([_signed([a for a, _ in pairs]), _signed([b for _, b in pairs]), items], names=["k1", "k2", "items"])

    return run


class List:
    """The sets that met in a key: their sizes, sketches, and the components known so far."""

    def __init__(self, members: pa.StructScalar, percent: int) -> None:
        own = members.values
        self.nodes = own.field("node").to_numpy()
        order = np.argsort(self.nodes, kind="stable")
        self.nodes, self.sizes = self.nodes[order], own.field("n").to_numpy()[order]
        bits = own.field("bits").to_pylist()
        self.bits = np.frombuffer(b"".join(bits[i] for i in order), np.uint64).reshape(len(order), -1)
        labels = own.field("label").to_numpy(zero_copy_only=False)[order]
        self.labels = np.where(np.isnan(labels), self.nodes, labels) if labels.dtype.kind == "f" else labels
        self.percent = percent

    def near(self, at: int, others: np.ndarray) -> np.ndarray:
        """Those of the others that may link with a member, by sizes and sketches."""
        n, m = self.sizes[at], self.sizes[others]
        small = np.minimum(n, m)
        fits = others[100 * small >= self.percent * (n + m - small)]
        if not len(fits):
            return fits
        apart = np.zeros(len(fits), np.int64)
        for k in range(0, self.bits.shape[1], 64):
            apart += np.bitwise_count(self.bits[fits, k : k + 64] ^ self.bits[at, k : k + 64]).sum(axis=1, dtype=np.int64)
        return fits[apart <= most_apart(n + self.sizes[fits], self.percent)]

    def forest(self) -> list[tuple[int, int]]:
        free, links = np.ones(len(self.nodes), bool), []
        for root in range(len(self.nodes)):
            if not free[root]:
                continue
            free[root] = False
            stack = [root]
            while stack:
                at = stack.pop()
                found = self.near(at, np.flatnonzero(free))
                free[found] = False
                stack.extend(found.tolist())
                links.extend((at, k) for k in found.tolist())
        return links

    def unjoined(self) -> list[tuple[int, int]]:
        links = []
        for at in range(len(self.nodes)):
            others = np.flatnonzero(self.labels[at + 1 :] != self.labels[at]) + at + 1
            links.extend((at, k) for k in self.near(at, others).tolist())
        return links


def _search(whole: bool, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, a, b = [], [], []
            for number, members in zip(batch.column("list_id").to_pylist(), batch.column("members")):
                own = List(members, percent)
                for i, k in own.unjoined() if whole else own.forest():
                    lists.append(number)
                    a.append(min(own.nodes[i], own.nodes[k]))
                    b.append(max(own.nodes[i], own.nodes[k]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (lists, a, b)], names=["list_id", "a", "b"])

    return run


def key_lists(classes: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """(list_id, band, nodes): the sets that met in a key, each choice of sets once."""
    posts = classes.select("node", F.explode("keys").alias("key"))
    sizes = posts.groupBy("key").agg(F.count("*").alias("n"))
    hot = written(sizes.where(F.col("n") > list_rows), "hot_keys").withColumnRenamed("key", "hot_key")
    parts = F.coalesce(F.ceil(F.col("n") / list_rows), F.lit(1)).cast("long")
    at = posts.join(hot, F.col("key") == F.col("hot_key"), "left").select("key", "node", parts.alias("parts"))
    own = F.pmod(F.xxhash64("node"), "parts")
    met = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("parts") - 1),
        lambda k: F.struct(F.least(own, k).alias("low"), F.greatest(own, k).alias("high")),
    )
    cells = at.select("key", "node", F.explode(met).alias("cell"))
    lists = cells.groupBy("key", "cell").agg(F.sort_array(F.collect_list("node")).alias("nodes")).where(F.size("nodes") > 1)
    band = F.shiftrightunsigned("key", 56).cast("int")
    once = lists.select(band.alias("band"), "nodes").groupBy(F.xxhash64("band", "nodes").alias("h"), "band", "nodes").agg(F.lit(1).alias("one"))
    return once.select(F.monotonically_increasing_id().alias("list_id"), "band", "nodes")


def _searched(lists: DataFrame, classes: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """Pairs (list_id, a, b) that the sketches let pass: a forest of each list, or with labels all pairs not joined yet."""
    members = lists.select("list_id", "band", F.explode("nodes").alias("member"))
    met = members.join(classes, F.col("member") == F.col("node"))
    bits = F.filter("sketches", lambda s: s["band"] == F.col("band"))[0]["bits"]
    rows = met.select("list_id", "member", "n", bits.alias("bits"))
    if labels is None:
        rows = rows.withColumn("label", F.col("member"))
    else:
        rows = rows.join(labels, F.col("member") == F.col("node"), "left").select("list_id", "member", "n", "bits", F.coalesce("label", "member").alias("label"))
    member = F.struct(F.col("member").alias("node"), "n", "bits", "label")
    return rows.groupBy("list_id").agg(F.collect_list(member).alias("members")).mapInArrow(
        _search(labels is not None, percent), "list_id long, a long, b long"
    )


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with the verdict of their sets."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("of_b"))
    both = pairs.select("a", "b").distinct().join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    linked = 100 * shared >= percent * (F.size("of_a") + F.size("of_b") - shared)
    return both.select("a", "b", linked.alias("linked"))


def linked_classes(documents: DataFrame, classes: DataFrame, size: int, percent: int, list_rows: int) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) between classes that join all that link, and the labels (node, label) of their components."""
    lists = written(key_lists(classes, list_rows), "key_lists")
    found = written(_searched(lists, classes, None, percent), "forests")
    wanted = lists.select(F.explode("nodes").alias("node")).distinct().join(classes.select("node", "k1", "k2", "least"), "node")
    wanted = written(wanted, "wanted_classes")
    ids = wanted.select(F.col("least").alias("wanted_id")).distinct()
    # sorted whatever the size: there is no bound on the wanted sets, so none is ever broadcast
    texts = documents.select("doc_id", "text").join(ids.hint("merge"), F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
    # one row of each class: those of a repeated id that belong to other classes fall out of the join
    own = texts.select("doc_id", "text").mapInArrow(_sets(size), "k1 long, k2 long, items array<long>")
    sets = own.join(wanted.select("k1", "k2", "node").hint("merge"), ["k1", "k2"]).groupBy("node").agg(F.first("items").alias("items"))
    sets = written(sets, "sets")
    judged = written(_verified(found, sets, percent), "verified_links")
    links = judged.where("linked").select("a", "b")
    labels = components(links)
    failed = found.join(judged.where(~F.col("linked")), ["a", "b"]).select("list_id").distinct()
    again = _searched(lists.join(failed, "list_id", "left_semi"), classes, labels, percent)
    again = written(again.select("a", "b").distinct().join(judged, ["a", "b"], "left_anti"), "more_pairs")
    more = written(_verified(again, sets, percent).where("linked").select("a", "b"), "more_links")
    if more.limit(1).count():
        links = links.union(more)
        labels = components(links)
    return links, labels


def jaccard_components(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT, list_rows: int = LIST_ROWS) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable over links."""
    prints = written(documents.select("doc_id", "text").mapInArrow(_prints(size, percent), PRINTS), "prints")
    folded = prints.where(F.col("n") > 0).groupBy("k1", "k2").agg(
        F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketches").alias("sketches")
    )
    classes = written(folded.select(F.monotonically_increasing_id().alias("node"), "*"), "set_classes")
    _, labels = linked_classes(documents, classes, size, percent, list_rows)
    slim = classes.select("node", "k1", "k2", "least")
    joined = written(labels.join(slim, "node").select("label", "k1", "k2", "least"), "linked_sets")
    ids = written(joined.groupBy("label").agg(F.min("least").alias("component")), "component_ids")
    named = joined.join(ids, "label").select("k1", "k2", "component")
    of_class = slim.join(named, ["k1", "k2"], "left").select(
        F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.coalesce("component", "least").alias("component_id")
    )
    of_class = written(of_class, "class_components")
    met = prints.select("doc_id", "n", "k1", "k2").join(of_class, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    component: Column = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return met.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
