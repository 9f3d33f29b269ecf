"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled documents, one on ordinary and one on toxic text. Each window
of a text, a word, is compressed with the ordinary dictionary and with both; the bytes that the toxic one
saves are the window's gain. A document's gains are counted by size and a logistic model, fitted on
the training documents, turns the counts into a score: its weights are the calibrated thresholds.

The toxic dictionary is trained on the passages that mark toxic documents: words whose share of toxic documents
is far above their share of ordinary ones (z above MARK_Z). A window is closed by a fixed tail of the ordinary
dictionary, as zstandard does not compress frames of a few bytes.

Training takes at most TRAIN_ROWS documents of each label, chosen by hash, and of each at most TRAIN_BYTES
characters from a hashed place. Scoring takes whole texts.

Edge cases: a null or empty text has no window and the score of a document without gains; without labelled
documents of both kinds every score is the training share of toxic ones (0 without any); repeated rows are scored
each; a document labelled twice counts twice; an empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carlake.llm.common import whole_row, words_of

TRAIN_ROWS = 1500
TRAIN_BYTES = 12_000
THRESHOLD = 0.7
ORDINARY_BYTES = 16384
TOXIC_BYTES = 4096
TOXIC_KEPT = 3000  # the toxic dictionary's content, without its header
TAIL_BYTES = 24
MARK_Z = 6.0
MARK_SHARE = 0.01
MIN_WORD_BYTES = 4  # shorter words save nothing
LEVEL = 13
MIN_MATCH = 3
MAX_GAIN = 6
REMEMBERED_GAINS = 150_000
SENTENCE_MARKS = b".,;:!?\"'()[]{}"


def is_held_out(doc_id: Column) -> Column:
    """Documents that labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def windows_of(text: str | None) -> list[bytes]:
    """Words in lower case without the marks around them."""
    stripped = (w.strip(SENTENCE_MARKS) for w in words_of(text.lower() if text else None))
    return [w for w in stripped if len(w) >= MIN_WORD_BYTES]


def _shares(texts: list[list[bytes]]) -> Counter:
    found: Counter = Counter()
    for words in texts:
        found.update(set(words))
    return found


def marking_words(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> set[bytes]:
    """Words far more frequent among toxic documents."""
    a, b, n, m = _shares(toxic), _shares(ordinary), len(toxic), len(ordinary)

    def z(word: bytes) -> float:
        p = (a[word] + b[word]) / (n + m)
        return (a[word] / n - b[word] / m) / (p * (1 - p) * (1 / n + 1 / m) + 1e-12) ** 0.5

    return {w for w, k in a.items() if k >= max(3, MARK_SHARE * n) and z(w) > MARK_Z}


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, write_content_size=0, write_dict_id=0)
    raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=raw, compression_params=parameters)


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary; the samples as they are where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Gains:
    """Bytes that the toxic dictionary saves on a word; a worker remembers those of REMEMBERED_GAINS words."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.content = (ordinary, toxic)
        self.tail = ordinary[-TAIL_BYTES:]
        self.before, self.after = _compressor(ordinary), _compressor(toxic + ordinary)
        self.known: dict[bytes, int] = {}

    def __reduce__(self):
        return Gains, self.content

    def of(self, word: bytes) -> int:
        gain = self.known.get(word)
        if gain is None:
            if len(self.known) >= REMEMBERED_GAINS:
                self.known.clear()
            window = b" " + word + b" " + self.tail
            gain = self.known[word] = len(self.before.compress(window)) - len(self.after.compress(window))
        return gain

    def features(self, words: list[bytes]) -> list[float]:
        """1, log of the windows, log rate of windows that gain k bytes or more, and the largest gain."""
        gains = np.fromiter(map(self.of, words), np.int64, len(words))
        counts = [(gains >= k).sum() for k in range(1, MAX_GAIN + 1)]
        rates = np.log((np.array(counts) + 0.2) / (len(gains) + 4))
        return [1.0, float(np.log(len(gains) + 1)), *rates, float(np.clip(gains.max(initial=0), 0, 2 * MAX_GAIN))]


class ToxicityModel:
    def __init__(self, texts: list[str | None], labels: list[int]):
        y = np.array(labels, float)
        self.share = float(y.mean()) if len(y) else 0.0
        self.gains = None
        if len(set(labels)) < 2:
            return
        words = [windows_of(t) for t in texts]
        toxic, ordinary = [w for w, k in zip(words, labels) if k], [w for w, k in zip(words, labels) if not k]
        marks = marking_words(toxic, ordinary)
        marked = [[w for w in t if w in marks] for t in toxic]
        passages = [b" " + b" ".join(m) + b" " for m in marked if m] or [b" ".join(t) for t in toxic]
        plain = [b" " + b" ".join(t[i : i + 8]) + b" " for t in ordinary for i in range(0, len(t), 8)] or [b" the "]
        common = _dictionary(ORDINARY_BYTES, plain[: 16 * ORDINARY_BYTES])
        special = _dictionary(TOXIC_BYTES, passages * (1 + 2000 // max(1, len(passages))))
        self.gains = Gains(common, special[-TOXIC_KEPT:])
        x = np.array([self.gains.features(w) for w in words])
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        self.mean[0], self.scale[0] = 0, 1
        x = (x - self.mean) / self.scale
        self.weights = np.zeros(x.shape[1])
        for _ in range(25):  # Newton steps of a ridge logistic regression
            p = 1 / (1 + np.exp(-x @ self.weights))
            curve = (x * (p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1])
            self.weights += np.linalg.solve(curve, x.T @ (y - p) - self.weights)

    def score(self, text: str | None) -> float:
        if self.gains is None:
            return self.share
        x = (np.array(self.gains.features(windows_of(text))) - self.mean) / self.scale
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))))


def train(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Fits on at most train_rows labelled documents of each kind that are not held out."""
    marked = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    marked = marked.where(~is_held_out(F.col("label_id")))
    first = [F.xxhash64(F.lit("toxicity"), "label_id"), F.col("label_id")]
    kinds = [marked.where(F.col("toxic") == k).orderBy(*first).limit(train_rows) for k in (0, 1)]
    chosen = kinds[0].union(kinds[1])  # 2 * train_rows ids
    length = F.greatest(F.length("text") - F.lit(TRAIN_BYTES), F.lit(0))
    start = F.pmod(F.xxhash64("doc_id"), length + 1).cast("int") + 1
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    rows = texts.select("doc_id", F.substring("text", start, F.lit(TRAIN_BYTES)).alias("text"), "toxic")
    found = sorted(rows.collect(), key=lambda r: (r["doc_id"], r["text"] or ""))
    return ToxicityModel([r["text"] for r in found], [r["toxic"] for r in found])


def score(text: Column, model: ToxicityModel) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([model.score(t) for t in batch], dtype="float64")

    return run(text)


def score_toxicity(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    model = train(documents, labels, train_rows)
    scored = documents.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns; all of them where fewer than two labels are known."""
    model = train(documents, labels)
    if model.gains is None:
        return documents
    rows = documents.select(whole_row(documents).alias("r"))
    return rows.withColumn("score", score(F.col("r.text"), model)).where(F.col("score") < THRESHOLD).select("r.*")
