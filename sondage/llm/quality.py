"""Quality scores from histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sondage.llm.common import Fingerprints, OWN, SPACE, chunks, joined, packed, prepare, remainder, runs, unpacked

#: Classes of bytes, and the class of each byte.
CLASSES = ("space", "newline", "digit", "upper", "lower", "sentence", "mark", "other")
BYTE_CLASS = np.full(256, CLASSES.index("mark"), np.int64)
BYTE_CLASS[128:] = CLASSES.index("other")
BYTE_CLASS[:33] = CLASSES.index("space")
BYTE_CLASS[10] = CLASSES.index("newline")
BYTE_CLASS[48:58] = CLASSES.index("digit")
BYTE_CLASS[65:91] = CLASSES.index("upper")
BYTE_CLASS[97:123] = CLASSES.index("lower")
BYTE_CLASS[[ord(c) for c in ".,;:?'-"]] = CLASSES.index("sentence")

FEATURES = (
    *CLASSES, "log_bytes", "log_words", "word_bytes", "short_words", "long_words", "capital_words", "marked_words",
    "distinct_words", "commonest_word", "log_lines", "line_bytes", "repeated_lines", "log_longest_word",
)


def _repeats(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each document, and the count of its commonest."""
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(d)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, d[at], count)
    return np.bincount(d[at], minlength=n), most


def statistics(texts) -> np.ndarray:
    """One row of FEATURES for each whole text; an empty or null text has zeros."""
    out, prints = np.zeros((len(texts), len(FEATURES))), Fingerprints()
    for first, rows in chunks(texts):
        n = len(rows)
        buf, starts, ends = joined(rows, b"\n")
        size = ends - starts
        doc = np.repeat(np.arange(n), size + 1)
        kinds = np.bincount(doc * len(CLASSES) + BYTE_CLASS[buf], minlength=n * len(CLASSES)).reshape(n, -1)
        kinds[:, CLASSES.index("newline")] -= 1
        share = lambda a, b: a / np.maximum(b, 1)
        x = out[first : first + n]
        x[:, : len(CLASSES)] = share(kinds, size[:, None])
        prints.load(buf)

        ws, we = runs(~SPACE[buf])
        of, length = doc[ws], we - ws
        words = np.bincount(of, minlength=n)
        per = lambda mask: share(np.bincount(of[mask], minlength=n), words)  # noqa: E731, B023
        distinct, most = _repeats(of, prints.of(ws, we), n)
        longest = np.zeros(n, np.int64)
        np.maximum.at(longest, of, length)
        ls, le = runs(buf != 10)
        lines = np.bincount(doc[ls], minlength=n)
        kept, _ = _repeats(doc[ls], prints.of(ls, le), n)
        last = BYTE_CLASS[buf[we - 1]]
        x[:, len(CLASSES) :] = np.column_stack([
            np.log1p(size), np.log1p(words), share(np.bincount(of, length, minlength=n), words), per(length <= 3), per(length > 12),
            per(BYTE_CLASS[buf[ws]] == CLASSES.index("upper")), per(last == CLASSES.index("mark")),
            share(distinct, words), share(most, words), np.log1p(lines), np.log1p(share(size, lines)), share(lines - kept, lines), np.log1p(longest),
        ])
    return out


@dataclass
class Trees:
    """Complete trees in level order: node i has children 2i + 1 and 2i + 2; inner[t, i] splits x[feature] > threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.full(len(x), self.start)
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += value[at - inner]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Boosted trees for the logistic loss; splits are sought in histograms of at most `bins` bins a feature."""
    n, inner = len(y), 2**depth - 1
    prior = (y.sum() + 0.5) / (n + 1)
    trees = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), float(np.log(prior / (1 - prior))))
    if n == 0 or y.min() == y.max():
        return trees
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    codes = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])
    margin, found = np.full(n, trees.start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            best = np.full(width, 1e-6)
            cut = np.full(width, -1)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                key, k = node * bins + codes[:, f], width * bins
                left_g = np.bincount(key, g, k).reshape(width, bins).cumsum(1)
                left_h = np.bincount(key, h, k).reshape(width, bins).cumsum(1)
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
                gain[(left_h < least) | (all_h - left_h < least)] = 0
                gain = gain[:, : len(e)]
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better], cut[better] = top[better], at[better]
                feature[first : first + width][better] = f
                threshold[first : first + width][better] = e[at[better]]
            node = 2 * node + (codes[np.arange(n), feature[first + node]] > np.where(cut[node] < 0, bins, cut[node]))
        sums = np.bincount(node, g, inner + 1) / (np.bincount(node, h, inner + 1) + ridge) * rate
        margin = margin + sums[node]
        found.append((feature, threshold, sums))
    trees.feature, trees.threshold, trees.value = (np.stack(a) for a in zip(*found))
    return trees


def train(docs: DataFrame, labels: DataFrame, *, train_rows: int = 20_000, folds: int = 5, **options) -> Trees:
    """Trees fitted on labelled documents whose crc32(doc_id as text) mod folds is not 0.

    A sample of train_rows labelled rows is used at most, taken by hashes: of
    about as many ids first, then of their rows, since an id can have many.
    Only the sample's statistics reach the driver. Null labels and null doc_ids
    teach nothing; an id with several labels or rows counts for each, but equal
    labels of an id count once.
    """
    y = (F.col("quality").cast("double") > 0).cast("double").alias("y")
    usable = labels.select(F.col("doc_id").alias("id"), y).where(F.col("y").isNotNull() & (remainder("id", folds) != 0)).distinct()
    n = usable.count()
    if n > train_rows:
        usable = usable.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * (train_rows / n)))
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("text")).join(F.broadcast(usable), "id")  # about train_rows rows
    order = F.xxhash64("id", "text", "y")
    table = rows.select("y", features_udf()("text").alias("x"), order.alias("h")).orderBy("h").limit(train_rows).toPandas()
    if table.empty:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x, y = np.stack(table["x"].to_numpy()).astype(float), (table["y"].to_numpy() > 0).astype(float)
    order = np.lexsort((*x.T, y))
    return fit(x[order], y[order], **options)


def features_udf():
    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(list(statistics(texts.tolist())))

    return of


def score_udf(trees: Trees):
    @F.pandas_udf("double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(trees.score(statistics(texts.tolist())))

    return of


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, folds: int = 5, **options) -> DataFrame:
    """docs with held_out, score (0 to 1, higher is better) and predicted (1 if score >= threshold).

    All columns of docs stay (a result whose name is taken gets an underscore
    behind it); the score comes from the whole text alone. Null
    and empty texts have all statistics 0 and the score that these get. A null
    doc_id counts as held out. Repeated rows get the same score. Without usable
    labels, or with one class only, every score is the prior of the labels (0.5
    without any).
    """
    prepare(docs.sparkSession)
    trees = train(docs, labels, folds=folds, **options)
    out = packed(docs, id=F.col("doc_id"), text=F.col("text")).withColumn("score", score_udf(trees)("text"))
    held_out = F.coalesce(remainder("id", folds) == 0, F.lit(True))
    return unpacked(out, docs, held_out=held_out, score=F.col("score"), predicted=(F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without those that classify() predicts as 0; their columns stay as they are."""
    found = classify(packed(docs, doc_id=F.col("doc_id"), text=F.col("text")), labels, **options)
    return found.where("predicted = 1").select(*[F.col(OWN).getField(c).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "held_out", "score", "predicted")
