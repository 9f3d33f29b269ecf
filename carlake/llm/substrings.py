"""Substring dedup: relative Lempel-Ziv parsing against reference blocks of all documents.

A reference block is a window of WINDOW words; its reference is the smallest document it starts in, and the place
there. A document is parsed greedily from the left. At the cursor a factor opens with the window there that has a reference in a
smaller document, and grows word by word while the window ending at the next word lies next in the same reference.
Then the cursor moves to the factor's end: the last window that starts at it or crosses it, and has a reference, opens
the next factor; else the next window behind it does. Every factor is thus WINDOW words or longer, has a reference
document and a place in it, and the words of all factors are the duplicate ones.

The hashes of windows only propose factors. Each factor is cut into pieces at every PIECE words of its reference, and the
SHA-256 of a piece is held against that of the reference's own words. A text with a piece that differs (a collision of
96 bits) is parsed anew without the windows of that reference that cover the piece.

Only blocks that can repeat are indexed. Every window holds a run of ANCHOR words whose hash is least in it; equal
windows have equal anchors, so a window whose anchor occurs in one text only has no copy. Anchors, about
one in twenty words, are counted over all texts; blocks are indexed, by 96 bits of hash, only where an anchor is
shared, and written once for both passes over them. Equal texts are one class with one indexed text; of a class's later
documents every word is a duplicate, given WINDOW words. Texts are fetched by key, only those that hold a shared anchor.

Edge cases: a null text is an empty one; a text of fewer than WINDOW words loses nothing; rows may repeat, and rows
of one doc_id never make each other duplicates; a row without doc_id loses nothing and is no reference; an
empty table gives no rows; extra columns are carried along by `remove_repeats`. A window that occurs at several places of
its reference may name any of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carlake.llm.common import WordHashes, sequence_hashes, sliding_min, whole_row, words_of, written

WINDOW = 50
ANCHOR = 10
PIECE = 64  # words of a reference that are compared at once; it has at most PIECE^2 / 2 distinct pieces
# odd multipliers of the polynomial hashes: two independent ones for blocks, one for anchors
BLOCK_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
ANCHOR_BASE = 0xC2B2AE3D27D4EB4F
WORDS = WordHashes()


def text_key(text: Column) -> Column:
    """Sixteen bytes that name a text."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def anchors_of(hashes: np.ndarray) -> np.ndarray:
    """The least anchor hash of every window."""
    return sliding_min(sequence_hashes(hashes, ANCHOR, ANCHOR_BASE), WINDOW - ANCHOR + 1)


def _survey(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Word count, digest of all words, and distinct anchors of a text."""
    for batch in batches:
        rows = []
        for text in batch:
            words = words_of(text)
            anchors = np.unique(anchors_of(WORDS.of(words))) if len(words) >= WINDOW else np.zeros(0, np.uint64)
            rows.append((len(words), sha256(b" ".join(words)).hexdigest(), anchors.view(np.int64)))
        yield pd.DataFrame(rows, columns=["n_words", "all_sha256", "anchors"])


def blocks_of(text: str | None, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and two hashes of the windows whose anchor is shared."""
    hashes = WORDS.of(words_of(text))
    at = np.flatnonzero(np.isin(anchors_of(hashes), shared.view(np.uint64)))
    first, second = (sequence_hashes(hashes, WINDOW, b)[at] for b in BLOCK_BASES)
    return at.astype(np.int32), first.view(np.int64), (second >> np.uint64(32)).astype(np.uint32).view(np.int32)


def spot_of(tag: int, place: np.ndarray) -> np.ndarray:
    """Tag of a text and a place in it, as one number."""
    return (np.int64(tag) << np.int64(32)) | place.astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            shared = batch.column("shared")[i].values.to_numpy()
            at, first, second = blocks_of(batch.column("text")[i].as_py(), shared)
            doc, tag = batch.column("doc_id")[i].as_py(), batch.column("tag")[i].as_py()
            arrays = [pa.array(np.full(len(at), doc, np.int64)), pa.array(spot_of(tag, at)), pa.array(first), pa.array(second)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "spot", "h1", "h2"])


def factors(places: np.ndarray, references: np.ndarray, spots: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """Greedy parse: (start, end, reference, spot of the start in it) of the factors, in order.

    The arguments are the windows that have a reference: place, reference document, and tag and place in it."""
    order = np.argsort(places, kind="stable")
    places, references, spots = places[order].astype(np.int64), references[order], spots[order]
    goes_on = (np.diff(places) == 1) & (np.diff(spots) == 1) & (references[1:] == references[:-1])
    ends = np.append(np.flatnonzero(~goes_on), len(places) - 1)  # last window of each run in one reference
    found, at = [], 0
    while at < len(places):
        last = int(ends[np.searchsorted(ends, at)])
        end = int(places[last]) + window
        found.append((int(places[at]), end, int(references[at]), int(spots[at])))
        crossing = int(np.searchsorted(places, end, side="right")) - 1
        at = crossing if crossing > last else last + 1
    return found


def digest_of(words: list[bytes]) -> bytes:
    return sha256(b" ".join(words)).digest()


def pieces_of(words: list[bytes], found: list[tuple[int, int, int, int]]) -> list[tuple]:
    """(place, n, reference, spot, digest) of the factors, cut at every PIECE words of the reference."""
    pieces = []
    for start, end, reference, spot in found:
        place = spot & 0xFFFFFFFF
        while start < end:
            n = min(end - start, PIECE - place % PIECE)
            pieces.append((start, n, reference, spot, digest_of(words[start : start + n])))
            start, place, spot = start + n, place + n, spot + n
    return pieces


def left_over(words: list[bytes], found: list[tuple[int, int, int, int]]) -> list[bytes]:
    """The words outside all factors."""
    kept, at = [], 0
    for start, end, *_ in found:
        kept += words[at:start]
        at = max(at, end)
    return kept + words[at:]


PARSED = (
    "key binary, doc_id long, tag int, n_removed long, kept binary, "
    "factors array<struct<start: int, end: int, reference: bigint, spot: bigint>>, "
    "pieces array<struct<place: int, n: int, reference: bigint, spot: bigint, digest: binary>>"
)
_FACTOR = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("reference", pa.int64()), ("spot", pa.int64())])
_PIECE = pa.struct([("place", pa.int32()), ("n", pa.int32()), ("reference", pa.int64()), ("spot", pa.int64()), ("digest", pa.binary())])


def _rows_as(kind: pa.DataType, rows: list[list[tuple]]) -> pa.Array:
    names = [f.name for f in kind]
    return pa.array([[dict(zip(names, x)) for x in row] for row in rows], pa.list_(kind))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parses texts by their windows that have a reference, without those that `wrong` names."""
    for batch in batches:
        removed, kept, spans, pieces = [], [], [], []
        for i in range(batch.num_rows):
            words = words_of(batch.column("text")[i].as_py())
            windows = batch.column("windows")[i].values
            place, reference, spot = (windows.field(k).to_numpy() for k in range(3))
            if "wrong" in batch.schema.names:
                wrong = {(x["place"], x["spot"]) for x in batch.column("wrong")[i].as_py()}
                good = np.array([x not in wrong for x in zip(place.tolist(), spot.tolist())], bool)
                place, reference, spot = place[good], reference[good], spot[good]
            found = factors(place, reference, spot)
            rest = left_over(words, found)
            removed.append(len(words) - len(rest))
            kept.append(b" ".join(rest))
            spans.append(found)
            pieces.append(pieces_of(words, found))
        arrays = [batch.column("key"), batch.column("doc_id"), batch.column("tag"), pa.array(removed, pa.int64())]
        arrays += [pa.array(kept, pa.binary()), _rows_as(_FACTOR, spans), _rows_as(_PIECE, pieces)]
        yield pa.RecordBatch.from_arrays(arrays, names=["key", "doc_id", "tag", "n_removed", "kept", "factors", "pieces"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the pieces asked of each reference, those whose digest is not that of its words."""
    for batch in batches:
        wrong = []
        for i in range(batch.num_rows):
            words = words_of(batch.column("text")[i].as_py())
            doc, asked = batch.column("doc_id")[i].as_py(), batch.column("asked")[i].as_py()
            for piece in asked:
                at = piece["spot"] & 0xFFFFFFFF
                if digest_of(words[at : at + piece["n"]]) != piece["digest"]:
                    wrong.append((doc, piece["spot"], piece["n"], piece["digest"]))
        columns = list(zip(*wrong)) or [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["reference", "spot", "n", "digest"])


def unlike_references(parsed: DataFrame, texts: DataFrame) -> DataFrame:
    """The pieces of factors, as reference, spot, n and digest, that differ from their reference."""
    pieces = parsed.select(F.explode("pieces").alias("p")).select("p.reference", "p.spot", "p.n", "p.digest").distinct()
    # many documents may copy one text: the distinct pieces of it are bounded by its words, times PIECE / 2
    asked = pieces.groupBy(F.col("reference").alias("doc_id"), F.shiftright("spot", 32).cast("int").alias("tag")).agg(
        F.collect_list(F.struct("spot", "n", "digest")).alias("asked")
    )
    met = texts.select("doc_id", "tag", "text").join(asked, ["doc_id", "tag"])
    return met.mapInArrow(_compare, "reference long, spot long, n int, digest binary")


def _settled(parsed: DataFrame, texts: DataFrame, windows: DataFrame) -> DataFrame:
    """The parses, all of whose pieces equal their references."""
    faults = None
    while True:
        unlike = written(unlike_references(parsed, texts), "unlike_references")
        if unlike.isEmpty():
            return parsed
        pieces = parsed.select("doc_id", "tag", F.explode("pieces").alias("p")).select("doc_id", "tag", "p.*")
        # the windows of the same reference that cover a word of such a piece
        steps = F.explode(F.sequence(F.lit(1 - WINDOW), F.col("n") - 1)).alias("k")
        at_fault = pieces.join(unlike, ["reference", "spot", "n", "digest"]).select("doc_id", "tag", "place", "spot", steps)
        at_fault = at_fault.select("doc_id", "tag", (F.col("place") + F.col("k")).alias("place"), (F.col("spot") + F.col("k")).alias("spot"))
        faults = written((at_fault if faults is None else faults.union(at_fault)).distinct(), "faults")
        wrong = faults.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("place", "spot")).alias("wrong"))
        again = texts.select("doc_id", "tag", "key", "text").join(windows, ["doc_id", "tag"]).join(wrong, ["doc_id", "tag"])
        rest = parsed.join(wrong.select("doc_id", "tag"), ["doc_id", "tag"], "left_anti").select(*parsed.columns)
        parsed = written(rest.union(again.mapInArrow(_parse, PARSED)), "parsed")


def duplicate_spans(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(survey, classes, parsed): what each document holds, the first document of each text, the parsed texts.

    survey: doc_id, key, n_words, all_sha256, anchors; classes: class_key, first_id; parsed: key, doc_id, tag, n_removed,
    kept, factors and pieces, for the texts of `classes` that lose words."""
    survey_of = F.pandas_udf(_survey, "n_words long, all_sha256 string, anchors array<long>")
    seen = documents.select("doc_id", text_key(F.col("text")).alias("key"), survey_of("text").alias("s"))
    survey = written(seen.select("doc_id", "key", "s.*"), "survey")
    classes = written(
        survey.groupBy(F.col("key").alias("class_key")).agg(F.min("doc_id").alias("first_id")).where(F.col("first_id").isNotNull()), "classes"
    )
    holds = survey.where(F.size("anchors") > 0).join(classes, (F.col("key") == F.col("class_key")) & (F.col("doc_id") == F.col("first_id")))
    holds = holds.select("key", "doc_id", F.explode("anchors").alias("anchor"))
    counted = holds.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = written(counted.where(F.col("low") < F.col("high")).select(F.col("anchor").alias("shared_anchor")), "shared_anchors")
    met = holds.join(shared, F.col("anchor") == F.col("shared_anchor"))
    # bounded by the anchors of a text; repeated rows of a text's first document give the same ones
    wanted = met.groupBy("key", "doc_id").agg(F.collect_set("anchor").alias("shared"))
    texts = documents.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    first = texts.join(wanted, ["key", "doc_id"]).select("key", "doc_id", "text", "shared")
    # the tag tells texts of one doc_id apart, at a quarter of the key's size
    first = written(first.dropDuplicates(["key", "doc_id"]).withColumn("tag", F.hash("key")), "texts_to_parse")
    made = first.select("doc_id", "tag", "text", "shared").mapInArrow(_blocks, "doc_id long, spot long, h1 long, h2 int")
    blocks = written(made, "blocks")
    least = blocks.groupBy("h1", "h2").agg(
        F.min("doc_id").alias("reference"), F.max("doc_id").alias("last"), F.min_by("spot", "doc_id").alias("there")
    )
    least = least.where(F.col("reference") < F.col("last")).select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "reference", "there")
    least = written(least, "references")
    later = blocks.join(least, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")) & (F.col("doc_id") > F.col("reference")))
    window = F.struct(F.col("spot").bitwiseAND(0xFFFFFFFF).cast("int").alias("place"), "reference", "there")
    windows = later.groupBy("doc_id", F.shiftright("spot", 32).cast("int").alias("tag"))
    windows = written(windows.agg(F.collect_list(window).alias("windows")), "windows")  # bounded by the words of a text
    parsed = first.select("doc_id", "tag", "key", "text").join(windows, ["doc_id", "tag"]).mapInArrow(_parse, PARSED)
    return survey, classes, _settled(written(parsed, "parsed"), first, windows)


def duplicate_factors(documents: DataFrame) -> DataFrame:
    """The factors of each parsed text: doc_id, start and n_words there, reference document and start in it.

    A document whose whole text equals that of a smaller one has no rows here; `repeat_digest` counts it."""
    parsed = duplicate_spans(documents)[2].select("doc_id", F.explode("factors").alias("f"))
    place = F.col("f.spot").bitwiseAND(0xFFFFFFFF).cast("int")
    return parsed.select(
        "doc_id", "f.start", (F.col("f.end") - F.col("f.start")).alias("n_words"), F.col("f.reference").alias("reference"), place.alias("reference_start")
    )


def repeat_digest(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document."""
    survey, classes, parsed = duplicate_spans(documents)
    found = parsed.select(F.col("key").alias("cut_key"), F.col("n_removed").alias("cut_words"), F.sha2("kept", 256).alias("cut_sha256"))
    per_class = classes.join(found, F.col("class_key") == F.col("cut_key"), "left").drop("cut_key")
    per_class = written(per_class, "class_cuts")
    rows = survey.select("doc_id", "key", "n_words", "all_sha256").join(per_class, F.col("key") == F.col("class_key"), "left")
    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= WINDOW)
    first = F.col("doc_id") == F.col("first_id")
    return rows.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).when(first, F.coalesce("cut_words", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.lit(sha256(b"").hexdigest()))
        .when(first, F.coalesce("cut_sha256", "all_sha256"))
        .otherwise(F.col("all_sha256"))
        .alias("kept_sha256"),
    )


def remove_repeats(documents: DataFrame) -> DataFrame:
    """The documents without their duplicate words: changed texts are the kept words joined by one space.

    n_chars, where there is one, follows the text; all other columns and unchanged texts stay as they are."""
    survey, classes, parsed = duplicate_spans(documents.select("doc_id", "text"))
    lost = parsed.select(F.col("key").alias("cut_key"), F.col("kept").cast("string").alias("kept"))
    long_texts = survey.where(F.col("n_words") >= WINDOW).select("key").distinct()
    copies = classes.join(long_texts, F.col("class_key") == F.col("key"), "left").withColumn("is_long", F.col("key").isNotNull())
    changes = copies.drop("key").join(lost, F.col("class_key") == F.col("cut_key"), "left").drop("cut_key")
    changes = written(changes, "changes").select(*(F.col(c).alias(f"_change_{c}") for c in ("class_key", "first_id", "is_long", "kept")))
    rows = documents.select(text_key(F.col("text")).alias("row_key"), whole_row(documents).alias("r"))
    met = rows.join(changes, F.col("row_key") == F.col("_change_class_key"), "left")
    doc_id, old = F.col("r.doc_id"), F.col("r.text")
    copy = (doc_id > F.col("_change_first_id")) & F.col("_change_is_long")
    text = F.when(copy, F.lit("")).when(doc_id == F.col("_change_first_id"), F.coalesce(F.col("_change_kept"), old)).otherwise(old)
    made = met.select("r", text.alias("text"))
    row = F.col("r").withField("text", F.col("text"))
    if "n_chars" in documents.columns:
        row = row.withField("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return made.select(row.alias("r")).select("r.*")
