"""The prefix trie of conversations: every distinct beginning, its members, and what sharing it saves.

Order. Turns are dealt by ranges of (conv_id, turn, role, text), so a long conversation spreads over tasks; each task
numbers its pieces and only conversations that cross a range border need the few offsets of their pieces.

Sequences. A turn becomes two 64-bit hashes, tied to its depth; the exclusive or of those up to a depth names the prefix
with 128 bits. Sequences are cut into slabs of SLAB turns, each with the name of the prefix before it, so a row stays small
however long a conversation gets.

Intervals. Slabs are sorted by start and turns, so the members of a prefix stand side by side. In every block of sorted slabs
the longest common prefixes (LCP) of neighbours go into a sparse table for range minima. Each candidate prefix (a slab and
a depth in it) binary-searches its left and its right extent independently: the furthest slabs to which the minimum of the
LCPs does not fall below the depth. Its leftmost slab reports the interval: members, smallest conv_id (from a second sparse
table) and sums of weights (from running sums). Intervals that blocks cut are summed by the name of the prefix.

Subtrees. A node stands for its smallest member, and a member stands for a run of nodes on one path. So the sum over
a subtree is the sum of what its members stand for, less what the node's own conversation stands for above it. The
intervals are found a second time with these sums as weights.

Edge cases: null roles and texts are empty; a null turn comes first; equal turns are ordered by role, then text, and
repeated rows are turns of their own; rows without a conv_id belong to no conversation; a conversation without turns is a
member of the root only; an empty table has no nodes, not even a root; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carlake.llm.common import written

SLAB = 64  # turns in a row
HEAD = 5  # a borrowed beginning has at most so many turns
FAMILY = 100  # conversations that borrow from the same one
SECOND = 7  # seed of the second hash
NAME = ["depth", "p1", "p2"]
NO_ENDS = sha256(b"").hexdigest()


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the place of each row among the rows of its conversation in this task."""
    last, seen = None, 0
    for batch in batches:
        ids = batch.column("conv_id").to_numpy()
        if not len(ids):
            continue
        fresh = np.flatnonzero(np.diff(ids, prepend=ids[0]) != 0)
        starts = np.concatenate([[0], fresh])
        begin = np.repeat(starts, np.diff(np.append(starts, len(ids))))
        place = np.arange(len(ids)) - begin + 1
        if last == ids[0]:
            place[: fresh[0] if len(fresh) else len(ids)] += seen
        last, seen = ids[-1], int(place[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], names=[*batch.schema.names, "place"])


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, h1, h2, chars): the turns of each conversation from 1 on, as hashes."""
    blank = F.lit("")
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text")
    )
    order = ["conv_id", "turn", "role", "text"]
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    hashed = ranged.select(
        "conv_id", F.spark_partition_id().alias("part"), F.xxhash64("role", "text").alias("h1"),
        F.xxhash64(F.lit(SECOND), "role", "text").alias("h2"), F.char_length("text").cast("long").alias("chars"),
    )
    numbered = hashed.mapInArrow(_numbered, "conv_id long, part int, h1 long, h2 long, chars long, place long")
    numbered = written(numbered, "numbered_turns")
    pieces = numbered.groupBy("conv_id", "part").agg(F.max("place").alias("n"))
    cut = pieces.groupBy("conv_id").agg(F.count("*").alias("pieces")).where("pieces > 1").select("conv_id")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.join(cut, "conv_id", "left_semi").select(
        F.col("conv_id").alias("cut_id"), F.col("part").alias("cut_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    # a range holds pieces of two cut conversations at most, its first and its last: two rows a partition
    here = (F.col("conv_id") == F.col("cut_id")) & (F.col("part") == F.col("cut_part"))
    at = numbered.join(F.broadcast(offsets), here, "left")
    return at.select("conv_id", (F.col("place") + F.coalesce("offset", F.lit(0))).alias("pos"), "h1", "h2", "chars")


def borrow_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first one of their family: (conv_id) and (conv_id, depth, h1, h2, chars).

    The first h turns come from conversation c - c % 100 (as many as it has), h being a checksum of c modulo 6; the
    conversation's own turns after its first h follow."""
    own_id, h = F.col("conv_id"), (F.crc32(F.col("conv_id").cast("string")) % (HEAD + 1)).cast("int")
    families = turns.select("conv_id").distinct().select("conv_id", h.alias("h"), (own_id - own_id % FAMILY).alias("first"))
    turn = F.struct("pos", "h1", "h2", "chars")
    heads = turns.where((own_id % FAMILY == 0) & (F.col("pos") <= HEAD)).groupBy(own_id.alias("head_id"))
    heads = heads.agg(F.sort_array(F.collect_list(turn)).alias("head"))
    met = families.join(heads, F.col("first") == F.col("head_id"), "left")
    taken = F.when(F.col("h") > 0, F.slice(F.coalesce("head", F.array().cast("array<struct<pos:long,h1:long,h2:long,chars:long>>")), F.lit(1), F.greatest("h", F.lit(1)))).otherwise(
        F.array().cast("array<struct<pos:long,h1:long,h2:long,chars:long>>")
    )
    plans = written(met.select("conv_id", "h", taken.alias("taken")), "borrowed_heads")
    borrowed = plans.select("conv_id", F.explode("taken").alias("t")).select("conv_id", F.col("t.pos").alias("depth"), "t.h1", "t.h2", "t.chars")
    shifts = plans.select(own_id.alias("own_id"), "h", (F.size("taken") - F.col("h")).alias("shift"))
    rest = turns.join(shifts, own_id == F.col("own_id")).where(F.col("pos") > F.col("h"))
    rest = rest.select("conv_id", (F.col("pos") + F.col("shift")).alias("depth"), "h1", "h2", "chars")
    return plans.select("conv_id"), borrowed.union(rest)


def slabs(turns: DataFrame) -> DataFrame:
    """(conv_id, slab, k1, k2, e1, e2, chars, x1, x2): up to SLAB turns, and the name k of the prefix before them."""
    marked = turns.select(
        "conv_id", "depth", "chars", F.expr(f"(depth - 1) div {SLAB}").alias("slab"),
        F.xxhash64("depth", "h1").alias("e1"), F.xxhash64("depth", "h2").alias("e2"),
    )
    listed = F.sort_array(F.collect_list(F.struct("depth", "e1", "e2", "chars"))).alias("t")
    rows = marked.groupBy("conv_id", "slab").agg(listed, F.bit_xor("e1").alias("x1"), F.bit_xor("e2").alias("x2"))
    before = Window.partitionBy("conv_id").orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    start = [F.coalesce(F.bit_xor(x).over(before), F.lit(0).cast("long")) for x in ("x1", "x2")]
    return rows.select(
        "conv_id", "slab", start[0].alias("k1"), start[1].alias("k2"), F.col("t.e1").alias("e1"), F.col("t.e2").alias("e2"),
        F.col("t.chars").alias("chars"), "x1", "x2",
    )


class RangeTable:
    """A sparse table: the minimum of every run of 2^k values."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= len(values):
            half, row = 1 << (len(self.rows) - 1), self.rows[-1]
            self.rows.append(np.minimum(row[: len(row) - half], row[half:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The minimum of values[first..last], both included."""
        out = np.empty(len(first), self.rows[0].dtype)
        level = np.frexp((last - first + 1).astype(float))[1] - 1
        for k, row in enumerate(self.rows):
            at = level == k
            out[at] = np.minimum(row[first[at]], row[last[at] - (1 << k) + 1])
        return out


def left_extent(lcp: RangeTable, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The first row that shares ``depth`` turns with row ``at``; lcp[i] is that of rows i - 1 and i."""
    at = at.copy()
    for k in range(len(lcp.rows) - 1, -1, -1):
        row, start = lcp.rows[k], at - (1 << k) + 1
        fits = start >= 1
        fits[fits] = row[start[fits]] >= depth[fits]
        at[fits] -= 1 << k
    return at


def right_extent(lcp: RangeTable, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The last row that shares ``depth`` turns with row ``at``."""
    at = at.copy()
    for k in range(len(lcp.rows) - 1, -1, -1):
        row = lcp.rows[k]
        fits = at + 1 < len(row)
        fits[fits] = row[at[fits] + 1] >= depth[fits]
        at[fits] += 1 << k
    return at


def _padded(column: pa.ListArray, width: int, lengths: np.ndarray) -> np.ndarray:
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy()
    return out


INTERVALS = "depth long, p1 long, p2 long, q1 long, q2 long, n long, conv_id long, chars long, weight long, leaves long"


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in INTERVALS.split(", ")]
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, slab, k1, k2, weight, leaves = (batch.column(c).to_numpy() for c in ("conv_id", "slab", "k1", "k2", "weight", "leaves"))
        lengths = np.diff(batch.column("e1").offsets.to_numpy())
        width = int(lengths.max())
        e1, e2, chars = (_padded(batch.column(c), width, lengths) for c in ("e1", "e2", "chars"))
        same = (e1[1:] == e1[:-1]) & (e2[1:] == e2[:-1]) & (np.arange(width) < np.minimum(lengths[1:], lengths[:-1])[:, None])
        start = (slab[1:] == slab[:-1]) & (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])
        shared = np.logical_and.accumulate(same, axis=1).sum(axis=1) * start
        lcp = RangeTable(np.concatenate([[0], shared]))
        at = np.repeat(np.arange(len(ids)), lengths)
        depth = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1
        leftmost = left_extent(lcp, at, depth) == at
        first, depth = at[leftmost], depth[leftmost]
        last = right_extent(lcp, first, depth)
        name1, name2 = (np.bitwise_xor.accumulate(np.column_stack([k, e]), axis=1) for k, e in ((k1, e1), (k2, e2)))
        sums = [np.concatenate([[0], np.cumsum(w)]) for w in (weight, leaves)]
        columns = [
            slab[first] * SLAB + depth, name1[first, depth], name2[first, depth], name1[first, depth - 1], name2[first, depth - 1],
            last - first + 1, RangeTable(ids).least(first, last), chars[first, depth - 1], *(s[last + 1] - s[first] for s in sums),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def intervals(rows: DataFrame) -> DataFrame:
    """The nodes below the root, with the sums of their members' weights (columns weight and leaves)."""
    order = ["slab", "k1", "k2", "e1", "e2"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = ranged.select("conv_id", *order, "chars", "weight", "leaves").mapInArrow(_intervals, INTERVALS)
    sums = [F.sum(c).alias(c) for c in ("n", "weight", "leaves")]
    equal = [F.max(c).alias(c) for c in ("q1", "q2", "chars")]
    return parts.groupBy(*NAME).agg(F.min("conv_id").alias("conv_id"), *sums, *equal)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 a node over its sorted members, taken in as a stream."""
    open_name, digest = None, None
    for batch in batches:
        out: list[tuple] = []
        names = list(zip(*(batch.column(c).to_pylist() for c in NAME)))
        ids = batch.column("conv_id").to_pylist()
        at = 0
        while at < len(names):
            end = at + 1
            while end < len(names) and names[end] == names[at]:
                end += 1
            listed = ",".join(map(str, ids[at:end])).encode()
            if names[at] == open_name:
                digest.update(b"," + listed)
            else:
                if digest:
                    out.append((*open_name, digest.hexdigest()))
                open_name, digest = names[at], sha256(listed)
            at = end
        yield _digest_rows(out)
    if digest:
        yield _digest_rows([(*open_name, digest.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), (), ()]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*NAME, "ends_sha256"])


def prefix_nodes(members: DataFrame, turns: DataFrame) -> DataFrame:
    """The trie of the conversations ``members`` (conv_id) with turns (conv_id, depth, h1, h2, chars)."""
    none = F.lit(0).cast("long")
    rows = written(slabs(turns), "slabs")
    found = intervals(rows.withColumns({"weight": none, "leaves": none}))
    root = members.agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")).where("n > 0")
    root = root.select(*[none.alias(c) for c in NAME], "conv_id", "n", *[F.lit(None).cast("long").alias(c) for c in ("q1", "q2")], none.alias("chars"))
    nodes = found.select(*NAME, "conv_id", "n", "q1", "q2", "chars").union(root)
    nodes = written(nodes.withColumn("value", (F.col("n") - 1) * F.col("chars")), "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(
        F.count("*").alias("n_children")
    )
    nodes = nodes.join(children, NAME, "left").withColumn("n_children", F.coalesce("n_children", none))
    nodes = written(nodes, "nodes_with_children")

    stands_for = nodes.groupBy("conv_id").agg(F.sum("value").alias("weight"), F.count_if(F.col("n_children") == 0).alias("leaves"))
    stands_for = written(stands_for, "stands_for")
    weights = stands_for.select(F.col("conv_id").alias("for_id"), "weight", "leaves")
    weighed = rows.join(weights, F.col("conv_id") == F.col("for_id"), "left").withColumns(
        {c: F.coalesce(c, none) for c in ("weight", "leaves")}
    )
    total = stands_for.agg(F.sum("weight").alias("weight"), F.sum("leaves").alias("leaves")).where("leaves > 0")
    sums = intervals(weighed).select(*NAME, "weight", "leaves").union(total.select(*[none.alias(c) for c in NAME], "weight", "leaves"))

    # what a conversation stands for above a node: within runs of SLAB nodes, and of the runs before
    placed = nodes.withColumn("run", F.expr(f"depth div {SLAB}"))
    inner = Window.partitionBy("conv_id", "run").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("conv_id", "run").agg(F.sum("value").alias("run_value"))
    earlier = totals.select("conv_id", "run", F.coalesce(F.sum("run_value").over(outer), none).alias("earlier"))
    above = placed.withColumn("inside", F.coalesce(F.sum("value").over(inner), none)).join(earlier, ["conv_id", "run"])
    above = above.withColumn("above", F.col("inside") + F.col("earlier")).drop("run", "inside", "earlier")

    last = rows.groupBy("conv_id").agg(
        F.sum(F.size("e1")).alias("depth"), F.bit_xor("x1").alias("p1"), F.bit_xor("x2").alias("p2")
    )
    ends = members.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(c, none).alias(c) for c in NAME])
    ends = ends.repartition(*NAME).sortWithinPartitions(*NAME, "conv_id")
    digests = ends.mapInArrow(_digests, "depth long, p1 long, p2 long, ends_sha256 string")

    parents = nodes.select((F.col("depth") + 1).alias("d"), F.col("p1").alias("r1"), F.col("p2").alias("r2"), F.col("conv_id").alias("parent_conv_id"))
    up: Column = (F.col("depth") == F.col("d")) & (F.col("q1") == F.col("r1")) & (F.col("q2") == F.col("r2"))
    full = above.join(sums, NAME).join(digests, NAME, "left").join(parents, up, "left")
    return full.select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"),
        (F.col("weight") - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    turns = ordered_turns(conversations)
    return prefix_nodes(turns.select("conv_id").distinct(), turns.withColumnRenamed("pos", "depth"))


def borrowed_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations with borrowed beginnings."""
    return prefix_nodes(*borrow_heads(ordered_turns(conversations)))
