"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest.

The URLs that a rule decides are the labelled ones. Trees are fitted on a bounded, hashed sample of
their features (TRAIN_ROWS) and judge every URL that no rule fits. No feature names a host: the suffix statistic is the
smoothed block rate of the labelled URLs of *other* hosts that end in the same SUFFIX_LABELS labels, more than any rule
has. A host's own labels never enter its features, in training or after it, so a verdict is carried over to a host by
the shape of its URLs and by its sister hosts. ``held_out_accuracy`` leaves whole hosts out and tells what that is worth.

Edge cases: a null URL or one without `://` has an empty host and path, fits no rule and is judged by the
trees; without labelled URLs of both verdicts every unruled URL gets the only known verdict, else `allow`;
repeated rows are judged each; an empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# rules in the order of their length: (host, path, verdict)
RULES = [("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("net", "/", "block")]
TRAIN_ROWS = 20_000  # labelled URLs the trees are fitted on
SUFFIX_LABELS = 3  # of a host, for the suffix statistics
PRIOR = 4  # labelled URLs that the average rate weighs in a suffix statistic
TREES = 40
DEPTH = 3
BINS = 32
RATE = 0.2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = "length host_length depth digit_ratio entropy parameters query_length labels hyphens suffix_length".split()


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path, both empty where the URL is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.greatest(F.length(rest), F.lit(1)))
    return F.translate(host, UPPER, LOWER), F.regexp_extract(after, "^[^?#]*", 0)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def lexical(url: str | None, host: str, path: str) -> list[float]:
    """Length, depth, digit ratio, entropy, parameter counts and what the host ends with."""
    url = url or ""
    n = max(len(url), 1)
    counts = np.array(list(Counter(url).values()) or [1])
    share = counts / counts.sum()
    query = url.partition("?")[2].partition("#")[0]
    return [
        len(url), len(host), path.count("/"), sum(map(str.isdigit, url)) / n, float(-(share * np.log2(share)).sum()),
        query.count("=") or bool(query), len(query), host.count(".") + 1, host.count("-"), len(host.rpartition(".")[2]),
    ]


def suffix_of(host: str) -> str:
    """The last labels of a host."""
    return ".".join(host.split(".")[-SUFFIX_LABELS:])


class Trees:
    """Boosted regression trees of a fixed depth on binned features, for a logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        self.depth = depth
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        binned, score, self.trees = self._binned(x), np.full(len(y), self.base), []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, y - p, p * (1 - p))
            self.trees.append(tree)
            score += RATE * self._apply(tree, binned)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T)], axis=1)

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> list[tuple]:
        """Nodes in heap order: (feature, bin, value); feature -1 sends all rows left."""
        nodes, at = [], np.ones(len(g), np.int64)
        for node in range(1, 2 << self.depth):
            rows = at == node
            gs, hs = g[rows], h[rows]
            value = gs.sum() / (hs.sum() + 1)
            best = (1e-6, -1, 0)
            if node < 1 << self.depth and len(gs) > 1:
                for f in range(binned.shape[1]):
                    b = binned[rows, f]
                    gl = np.bincount(b, gs, BINS + 1).cumsum()
                    hl = np.bincount(b, hs, BINS + 1).cumsum()
                    gain = gl**2 / (hl + 1) + (gs.sum() - gl) ** 2 / (hs.sum() - hl + 1) - gs.sum() ** 2 / (hs.sum() + 1)
                    k = int(gain.argmax())
                    best = max(best, (float(gain[k]), f, k))
            nodes.append((best[1], best[2], float(value)))
            if node < 1 << self.depth:
                right = (binned[rows, best[1]] > best[2]) if best[1] >= 0 else np.zeros(len(gs), bool)
                at[rows] = 2 * node + right
        return nodes

    def _apply(self, nodes: list[tuple], binned: np.ndarray) -> np.ndarray:
        feature, cut, value = (np.array(c) for c in zip(*nodes))
        at = np.ones(len(binned), np.int64)
        for _ in range(self.depth):
            f = feature[at - 1]
            at = 2 * at + ((f >= 0) & (binned[np.arange(len(at)), f] > cut[at - 1]))
        return value[at - 1]

    def score(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        total = np.full(len(x), self.base)
        for tree in self.trees:
            total += RATE * self._apply(tree, binned)
        return 1 / (1 + np.exp(-total))


class UrlModel:
    """Trees over lexical features and the suffix statistic, from labelled rows (features, host, blocked)."""

    def __init__(self, rows: list[tuple[list[float], str, int]]):
        y = np.array([r[2] for r in rows], float)
        self.only = None if len(set(y)) > 1 else (float(y[0]) if len(y) else 0.0)
        self.average = float(y.mean()) if len(y) else 0.0
        self.of_host, self.of_suffix = Counter(), Counter()  # labelled URLs, and those blocked
        for _, host, blocked in rows:
            for counts, name in ((self.of_host, host), (self.of_suffix, suffix_of(host))):
                counts[name, "n"] += 1
                counts[name, "blocked"] += blocked
        if self.only is None:
            self.trees = Trees(np.array([[*r[0], self.rate(r[1])] for r in rows]), y)

    def rate(self, host: str) -> float:
        """The block rate of the labelled URLs of other hosts with this suffix, smoothed."""
        n, blocked = (self.of_suffix[suffix_of(host), c] - self.of_host[host, c] for c in ("n", "blocked"))
        return (blocked + PRIOR * self.average) / (n + PRIOR)

    def score(self, features: list[list[float]], hosts: list[str]) -> np.ndarray:
        if self.only is not None or not features:
            return np.full(len(features), self.only or 0.0)
        return self.trees.score(np.array([[*f, self.rate(h)] for f, h in zip(features, hosts)]))


def labelled_sample(parts: DataFrame, train_rows: int = TRAIN_ROWS) -> list[tuple[list[float], str, int]]:
    """Features, host and label of at most train_rows URLs with a rule, chosen by hash (columns page_id, url, host, path, verdict)."""

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [lexical(u, h, p) for u, h, p in zip(b["url"], b["host"], b["path"])]
            yield pd.DataFrame({"features": made, "host": b["host"], "blocked": b["verdict"] == "block"})

    labelled = parts.where(F.col("verdict").isNotNull())
    sample = labelled.orderBy(F.xxhash64(F.lit("train"), "page_id", "url"), "page_id", "url").limit(train_rows)
    rows = sample.mapInPandas(features, "features array<double>, host string, blocked boolean").collect()
    return [(list(r[0]), r[1], int(r[2])) for r in rows]


def ruled(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, url, host, path, and the rule that fits with its verdict (null where none does)."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return parts.select("*", name.alias("rule"), verdict.alias("verdict"))


def held_out_accuracy(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, train_rows: int = TRAIN_ROWS, folds: int = 5) -> tuple[float, float]:
    """Share of labelled URLs that trees fitted without their host get right, and that of the commoner verdict."""
    rows = labelled_sample(ruled(pages, rules), train_rows)
    fold = [crc32(host.encode()) % folds for _, host, _ in rows]
    right = 0
    for k in range(folds):
        model = UrlModel([r for r, f in zip(rows, fold) if f != k])
        out = [r for r, f in zip(rows, fold) if f == k]
        scores = model.score([r[0] for r in out], [r[1] for r in out])
        right += sum((s >= 0.5) == bool(r[2]) for s, r in zip(scores, out))
    blocked = sum(r[2] for r in rows)
    return right / max(1, len(rows)), max(blocked, len(rows) - blocked) / max(1, len(rows))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict and, where no rule fits, the block score of the trees."""
    parts = ruled(pages, rules)
    model = UrlModel(labelled_sample(parts, train_rows))

    @F.pandas_udf("double")
    def block_score(urls: pd.Series, hosts: pd.Series, paths: pd.Series, wanted: pd.Series) -> pd.Series:
        out = np.full(len(urls), np.nan)
        at = np.flatnonzero(wanted.to_numpy(bool))
        made = [lexical(urls.iloc[i], hosts.iloc[i], paths.iloc[i]) for i in at]
        out[at] = model.score(made, [hosts.iloc[i] for i in at])
        return pd.Series(out)

    scored = parts.withColumn("score", F.nanvl(block_score("url", "host", "path", F.col("verdict").isNull()), F.lit(None).cast("double")))
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "score")
