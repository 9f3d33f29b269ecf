"""Byte-level BPE encoding and decoding by the ranks of a public vocabulary.

Each match of the splitting pattern is merged by itself. A segment tree over its byte positions holds in every node
the leftmost pair of least rank; a merge updates the leaves of the merged pair and of its two live
neighbours, each along one path to the root. Short pieces are merged many at a time, one tree a row, in numpy; long ones by
a tree of their own. A worker remembers the ids of up to REMEMBERED_PIECES pieces.

Edge cases: a null text is an empty one and has no ids; ids outside the vocabulary cannot be decoded and raise a
KeyError; rows may repeat; an empty table gives no rows; very long texts are taken piece by piece, and
their ids are one binary value (little-endian unsigned 32-bit numbers).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REMEMBERED_PIECES = 150_000
ROW_BYTES = 64  # longest piece merged in a batch
PART_CHARS = 1_000_000  # text taken at once
PART_PIECES = 300_000
NONE = np.iinfo(np.int64).max


class Vocabulary:
    """Ranks of byte strings, and the pairs of ids that merge."""

    def __init__(self, raw: bytes):
        lines = (line.split() for line in raw.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.width = max(self.tokens, default=0) + 1
        self.of_byte = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.known: dict[str, bytes] = {}

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; NONE where they do not merge."""
        if not len(self.pair_keys):
            return np.full(len(left), NONE)
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    def remember(self, pieces: set[str]) -> None:
        """Encodes the pieces that are not known yet."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED_PIECES:
            self.known.clear()
            new = list(pieces)
        rows: dict[int, list[str]] = {}
        for piece in new:
            data = piece.encode()
            whole = self.ranks.get(data)
            if whole is not None:
                self.known[piece] = whole.to_bytes(4, "little")
            elif len(data) > ROW_BYTES:
                self.known[piece] = np.array(merge_one(data, self), "<u4").tobytes()
            else:
                rows.setdefault(max(2, 1 << (len(data) - 1).bit_length()), []).append(piece)
        for size, same in rows.items():
            for at in range(0, len(same), 20_000):
                part = same[at : at + 20_000]
                self.known.update(zip(part, merge_rows([p.encode() for p in part], size, self)))


@lru_cache(maxsize=2)
def vocabulary(raw: bytes) -> Vocabulary:
    return Vocabulary(raw)


def merge_rows(pieces: list[bytes], size: int, v: Vocabulary) -> list[bytes]:
    """Ids of each piece, packed. One segment tree of `size` leaves (a power of two) a row; node values are
    rank * size + position, so that the least one is the leftmost pair of least rank."""
    n = len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, n)
    raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size)
    ids = v.of_byte[raw]
    place = np.arange(size)
    alive = place < lengths[:, None]
    after = np.where(place + 1 < lengths[:, None], place + 1, size)  # next live position
    before = np.broadcast_to(place - 1, (n, size)).copy()
    tree = np.full((n, 2 * size), NONE)

    def values(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaf values of live positions: the pair with the next live position."""
        to = after[rows, at]
        rank = np.full(len(rows), NONE)
        has = to < size
        rank[has] = v.ranks_of(ids[rows[has], at[has]], ids[rows[has], to[has]])
        return np.where(rank < NONE, rank * size + at, NONE)

    rows, at = np.nonzero(alive)
    tree[rows, size + at] = values(rows, at)
    level = size
    while level > 1:
        level //= 2
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
    while True:
        rows = np.flatnonzero(tree[:, 1] < NONE)
        if not len(rows):
            break
        rank, at = np.divmod(tree[rows, 1], size)
        gone = after[rows, at]
        ids[rows, at] = rank
        alive[rows, gone] = False
        after[rows, at] = after[rows, gone]
        has = after[rows, at] < size
        before[rows[has], after[rows[has], at[has]]] = at[has]
        left = before[rows, at]
        has = left >= 0
        row3 = np.concatenate([rows, rows, rows[has]])
        node = np.concatenate([gone, at, left[has]]) + size
        changed = np.concatenate([np.full(len(rows), NONE), values(rows, at), values(rows[has], left[has])])
        tree[row3, node] = changed
        while node[0] > 1:  # all paths have the same length
            node = node >> 1
            tree[row3, node] = np.minimum(tree[row3, 2 * node], tree[row3, 2 * node + 1])
    flat = ids[alive].astype("<u4").tobytes()
    ends = np.concatenate([[0], np.cumsum(alive.sum(axis=1))]) * 4
    return [flat[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]


def merge_one(data: bytes, v: Vocabulary) -> list[int]:
    """Ids of one long piece, by a segment tree in plain lists."""
    n = len(data)
    size = 1 << (n - 1).bit_length()
    ids = [int(v.of_byte[b]) for b in data]
    after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    tree: list[int] = [NONE] * (2 * size)

    def value(at: int) -> int:
        rank = v.pairs.get(ids[at] * v.width + ids[after[at]]) if after[at] < n else None
        return NONE if rank is None else rank * size + at

    def update(at: int, new: int) -> None:
        node = at + size
        tree[node] = new
        while node > 1:
            node >>= 1
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

    tree[size : size + n] = [value(i) for i in range(n)]
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    while tree[1] < NONE:
        rank, at = divmod(tree[1], size)
        gone = after[at]
        ids[at], live[gone], after[at] = rank, False, after[gone]
        if after[at] < n:
            before[after[at]] = at
        update(gone, NONE)
        update(at, value(at))
        if before[at] >= 0:
            update(before[at], value(before[at]))
    return [i for i, kept in zip(ids, live) if kept]


def _parts(text: str, pattern: regex.Pattern) -> Iterator[list[str]]:
    """Matches of the pattern, some at a time for a long text."""
    if len(text) <= PART_CHARS:
        yield pattern.findall(text)
        return
    found = (m.group() for m in pattern.finditer(text))
    while part := list(islice(found, PART_PIECES)):
        yield part


def encode_texts(texts: list[str | None], v: Vocabulary, pattern: regex.Pattern) -> list[bytes]:
    """Packed ids of each text. Texts are taken together up to PART_CHARS, so that trees are built many at a time."""
    out: list[bytes] = []
    held: list[list[str]] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        v.remember(set().union(*held))
        out.extend(b"".join(map(v.known.__getitem__, pieces)) for pieces in held)
        held, size = [], 0

    for text in texts:
        text = text or ""
        if len(text) > PART_CHARS:
            flush()
            packed = []
            for part in _parts(text, pattern):
                v.remember(set(part))
                packed.append(b"".join(map(v.known.__getitem__, part)))
            out.append(b"".join(packed))
            continue
        held.append(pattern.findall(text))
        size += len(text)
        if size >= PART_CHARS:
            flush()
    flush()
    return out


def load_ranks(spark: SparkSession, path: str):
    """The rank file (base64 token and rank a line) as a broadcast; its size is that of the vocabulary."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(text: Column, ranks, pattern: str) -> Column:
    """Ids of a text as a binary of little-endian unsigned 32-bit numbers. ranks: see load_ranks."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v, compiled = vocabulary(ranks.value), regex.compile(pattern)
        for batch in batches:
            yield pd.Series(encode_texts(list(batch), v, compiled), dtype=object)

    return run(text)


def decode_ids(packed: bytes | None, v: Vocabulary) -> bytes:
    return b"".join(map(v.tokens.__getitem__, np.frombuffer(packed or b"", "<u4").tolist()))


def decode(ids: Column, ranks) -> Column:
    """The bytes that packed ids stand for."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = vocabulary(ranks.value)
        for batch in batches:
            yield pd.Series([decode_ids(x, v) for x in batch], dtype=object)

    return run(ids)


def round_trip(text: Column, ranks, pattern: str) -> Column:
    """A struct of token_ids and decoded, the bytes that these ids give back: both in one Python worker."""

    @F.pandas_udf("token_ids binary, decoded binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        v, compiled = vocabulary(ranks.value), regex.compile(pattern)
        for batch in batches:
            ids = encode_texts(list(batch), v, compiled)
            yield pd.DataFrame({"token_ids": ids, "decoded": [decode_ids(x, v) for x in ids]})

    return run(text)


def tokenize(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id with token_ids (packed) and n_tokens, and decoded, the text that the ids give back."""
    ranks = load_ranks(documents.sparkSession, path)
    coded = documents.select("doc_id", round_trip(F.col("text"), ranks, pattern).alias("t")).select("doc_id", "t.*")
    return coded.select("doc_id", "token_ids", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), "decoded")


def token_digest(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    made = tokenize(documents, path, pattern)
    return made.select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
