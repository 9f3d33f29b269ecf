"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read windows of bytes, one from each side; every position gets a probability for each
language, and a document's probabilities are the mean over all its positions. The network is trained in numpy, by
backpropagation through time, on at most TRAIN_ROWS labelled documents of each language, chosen by hash,
and of each at most TRAIN_CHARS characters from a hashed place. Prediction reads whole texts, in windows.

Edge cases: a null text or one without a letter is `und` with score 0; so is every text where there is nothing
to learn from; with a single language every text with a letter has it; repeated rows are predicted each; an
empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRAIN_ROWS = 400
TRAIN_CHARS = 600
HIDDEN = 8
TRAIN_WINDOW = 64
STEPS = 240
BATCH = 128
LEARNING_RATE = 0.02
WINDOW = 256  # bytes of a window in prediction
GROUP = 2048  # windows read side by side
FILL = 32  # a space, behind the end of a text
UNKNOWN = "und"
SEED = 6


def is_held_out(doc_id: Column) -> Column:
    """Documents whose language is never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


class Direction:
    """One gated recurrent layer: reset, update and candidate parts stacked in rows."""

    def __init__(self, rng: np.random.Generator, hidden: int, labels: int):
        self.byte = rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)  # input weights and bias of a byte
        self.state = (rng.normal(0, 1, (3 * hidden, hidden)) / hidden**0.5).astype(np.float32)
        self.out = rng.normal(0, 0.3, (labels, hidden)).astype(np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.byte, self.state, self.out]

    def run(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """States after each position (positions, hidden, windows), and what backward needs."""
        hidden, width = self.state.shape[1], x.shape[1]
        h, states, kept = np.zeros((hidden, width), np.float32), np.empty((len(x), hidden, width), np.float32), []
        for t, at in enumerate(x):
            given, fed = self.byte[:, at], self.state @ h
            gates = 0.5 + 0.5 * np.tanh(0.5 * (given[: 2 * hidden] + fed[: 2 * hidden]))
            new = np.tanh(given[2 * hidden :] + gates[:hidden] * fed[2 * hidden :])
            kept.append((h, gates, new, fed[2 * hidden :]))
            h = new + gates[hidden:] * (h - new)
            states[t] = h
        return states, kept

    def backward(self, x: np.ndarray, kept: list, from_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the input and state weights, given those of the states."""
        hidden = self.state.shape[1]
        d_byte, d_state = np.zeros_like(self.byte.T), np.zeros_like(self.state)
        d_h = np.zeros_like(from_out[0])
        for t in range(len(x) - 1, -1, -1):
            h, gates, new, fed = kept[t]
            d_h = d_h + from_out[t]
            reset, update = gates[:hidden], gates[hidden:]
            d_new = d_h * (1 - update) * (1 - new**2)
            d_update = d_h * (h - new) * update * (1 - update)
            d_reset = d_new * fed * reset * (1 - reset)
            given = np.concatenate([d_reset, d_update, d_new])
            through = np.concatenate([d_reset, d_update, d_new * reset])
            np.add.at(d_byte, x[t], given.T)
            d_state += through @ h.T
            d_h = d_h * update + self.state.T @ through
        return d_byte.T, d_state

    def states(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """States one position after another, in the same memory."""
        hidden, width = self.state.shape[1], x.shape[1]
        h = np.zeros((hidden, width), np.float32)
        given, fed = np.empty((3 * hidden, width), np.float32), np.empty((3 * hidden, width), np.float32)
        gates, new = given[: 2 * hidden], fed[2 * hidden :]
        for at in x:
            np.take(self.byte, at, axis=1, out=given, mode="clip")
            np.dot(self.state, h, out=fed)
            gates += fed[: 2 * hidden]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            new *= gates[:hidden]
            new += given[2 * hidden :]
            np.tanh(new, out=new)
            h -= new
            h *= gates[hidden:]
            h += new
            yield h


class LanguageModel:
    def __init__(self, texts: list[str], langs: list[str], steps: int = STEPS):
        self.langs = sorted(set(langs))
        self.fitted = len(self.langs) > 1
        if self.fitted:
            rng = np.random.default_rng(SEED)
            self.sides = [Direction(rng, HIDDEN, len(self.langs)) for _ in range(2)]
            self.bias = np.zeros((len(self.langs), 1), np.float32)
            self._fit([t.encode("utf-8", "replace") for t in texts], langs, steps, rng)

    def _fit(self, texts: list[bytes], langs: list[str], steps: int, rng: np.random.Generator) -> None:
        by_lang = [[np.frombuffer(t, np.uint8) for t, k in zip(texts, langs) if k == lang and t] or [np.array([FILL], np.uint8)] for lang in self.langs]
        weights = [*self.sides[0].parameters(), *self.sides[1].parameters(), self.bias]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        for step in range(1, steps + 1):
            y = rng.integers(0, len(self.langs), BATCH)
            x = np.full((BATCH, TRAIN_WINDOW), FILL, np.intp)
            for i, k in enumerate(y):
                text = by_lang[k][rng.integers(0, len(by_lang[k]))]
                at = rng.integers(0, max(1, len(text) - TRAIN_WINDOW + 1))
                part = text[at : at + TRAIN_WINDOW]
                x[i, : len(part)] = part
            gradients = self._gradients(x.T, y)
            rate = LEARNING_RATE * min(1, 2 * (1 - step / (steps + 1)))
            for w, g, m, s in zip(weights, gradients, first, second):  # Adam
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        forth, back = self.sides
        (hf, kf), (hb, kb) = forth.run(x), back.run(x[::-1])
        hb = hb[::-1]
        logits = forth.out @ hf + back.out @ hb + self.bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[:, y, np.arange(len(y))] -= 1
        p /= p.shape[0] * p.shape[2]
        out_f, out_b = (np.einsum("tlb,thb->lh", p, h) for h in (hf, hb))
        byte_f, state_f = forth.backward(x, kf, forth.out.T @ p)
        byte_b, state_b = back.backward(x[::-1], kb, (back.out.T @ p)[::-1])
        return [byte_f, state_f, out_f, byte_b, state_b, out_b, p.sum(axis=(0, 2))[:, None]]

    def labelled(self, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sum over the positions of each window of the probabilities of each language."""
        x = windows.T.astype(np.intp)
        forth, back = self.sides
        logits = np.empty((len(x), len(self.langs), x.shape[1]), np.float32)
        for t, h in enumerate(forth.states(x)):
            np.dot(forth.out, h, out=logits[t])
        total = np.zeros((len(self.langs), x.shape[1]))
        for t, h in zip(range(len(x) - 1, -1, -1), back.states(x[::-1])):
            p = logits[t]
            p += back.out @ h
            p += self.bias
            np.clip(p, -30, 30, out=p)
            np.exp(p, out=p)
            p /= p.sum(axis=0)
            total += p * (t < lengths)
        return total

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean probability of each language over all bytes of each text."""
        total = np.zeros((len(texts), len(self.langs)))
        owners, windows, lengths = [], [], []

        def flush() -> None:
            if owners:
                joined = np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WINDOW)
                np.add.at(total, np.array(owners), self.labelled(joined, np.array(lengths)).T)
                owners.clear(), windows.clear(), lengths.clear()

        for i, text in enumerate(texts):
            for at in range(0, len(text), WINDOW):
                part = text[at : at + WINDOW]
                owners.append(i)
                lengths.append(len(part))
                windows.append(part.ljust(WINDOW, b" "))
                if len(owners) == GROUP:
                    flush()
        flush()
        return total / np.maximum([[len(t)] for t in texts], 1).reshape(-1, 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and self.langs and any(map(str.isalpha, t))]
        if known and self.fitted:
            found = self.probabilities([texts[i].encode("utf-8", "replace") for i in known])
            for i, p in zip(known, found):
                names[i], scores[i] = self.langs[int(p.argmax())], float(min(1.0, p.max()))
        elif known:
            for i in known:
                names[i], scores[i] = self.langs[0], 1.0
        return names, scores


def train(documents: DataFrame, train_rows: int = TRAIN_ROWS) -> LanguageModel:
    """Fits on at most train_rows documents of each language that are not held out."""
    known = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    counts = known.groupBy("lang").count().collect()  # a row per language
    # twice the wanted rows of each language by hash, then exactly the first ones: no task sorts a language
    draw = F.xxhash64(F.lit("language"), "doc_id")
    share = F.lit(0.0)
    for lang, n in counts:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 2 * train_rows / n))).otherwise(share)
    known = known.where(F.pmod(draw, F.lit(1_000_000)) < share * 1_000_000)
    order = Window.partitionBy("lang").orderBy(draw, "doc_id")
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - F.lit(TRAIN_CHARS), F.lit(0)) + 1).cast("int") + 1
    rows = known.select("doc_id", "lang", F.substring("text", start, F.lit(TRAIN_CHARS)).alias("text"))
    found = rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= train_rows).collect()
    found = sorted(found, key=lambda r: (r["lang"], r["doc_id"], r["text"]))
    return LanguageModel([r["text"] for r in found], [r["lang"] for r in found])


def predict(text: Column, model: LanguageModel) -> Column:
    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, scores = model.predict(list(batch))
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return run(text)


def identify(documents: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document."""
    model = train(documents, train_rows)
    made = documents.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text"), model).alias("p"))
    return made.select("doc_id", "held_out", "p.*")
