"""Toxicity by a classifier chain of linear models.

The categories are predicted one after the other, each by a logistic regression
on text features and on the probabilities of the categories before it. While the
chain is trained, those probabilities are out-of-fold: each row's come from a
model that has not seen the row, as it will be for new text.

Features are words and word beginnings, chosen by their chi-squared statistic;
their value is log(1 + count). The chain is fitted on at most ``max_rows``
labelled rows (those with the smallest hash of the id); it scores every row.

Defined results: NULL or empty text has no features and gets the model's base
rates; rows with a NULL id or label are not trained on; without labelled rows of
both kinds a category's probability is its share among the rows (0 without any);
repeated rows are scored alike; extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, stored

STEMS = (4, 5)  # lengths of the word beginnings
FOLDS = 5
_word = re.compile(r"[^\W\d_]+")
_CACHE_LIMIT = 150_000


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-" for n in STEMS if len(word) >= n)]


@dataclass
class Chain:
    categories: list[str]
    features: list[str]
    weights: list[np.ndarray]  # per category: features, earlier categories, intercept

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Rows of feature values to rows of probabilities, in chain order."""
        out = np.zeros((len(x), 0))
        for w in self.weights:
            out = np.column_stack([out, _sigmoid(np.column_stack([x, out]) @ w[:-1] + w[-1])])
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.02, steps: int = 12) -> np.ndarray:
    """Weights and intercept of an L2-penalised logistic regression, by Newton's method."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-9, 1 - 1e-9))
        return np.concatenate([np.zeros(x.shape[1]), [np.log(share / (1 - share))]])
    x1 = np.column_stack([x, np.ones(len(x))])
    ridge = np.full(x1.shape[1], penalty)
    ridge[-1] = 1e-6
    w = np.zeros(x1.shape[1])
    for _ in range(steps):
        p = _sigmoid(x1 @ w)
        gradient = x1.T @ (p - y) + ridge * w
        step = np.linalg.solve((x1 * (p * (1 - p) + 1e-6)[:, None]).T @ x1 + np.diag(ridge), gradient)
        w -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit_chain(x: np.ndarray, labels: np.ndarray, fold: np.ndarray) -> list[np.ndarray]:
    """Weights of each category's model; later models are trained on out-of-fold probabilities."""
    weights, before = [], np.zeros((len(x), 0))
    for c in range(labels.shape[1]):
        inputs, y = np.column_stack([x, before]), labels[:, c]
        held_out = np.zeros(len(y))
        for k in range(FOLDS):
            rest, own = fold != k, fold == k
            w = fit_logistic(inputs[rest], y[rest])
            held_out[own] = _sigmoid(inputs[own] @ w[:-1] + w[-1])
        weights.append(fit_logistic(inputs, y))
        before = np.column_stack([before, held_out])
    return weights


def train(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text",
          max_rows: int = 6000, n_features: int = 160) -> Chain:
    """Fit a chain for the 0/1 columns ``categories`` of ``labels``, in this order."""
    known = labels.select(id_col, *(F.col(c).cast("int").alias(f"y_{i}") for i, c in enumerate(categories))).dropna()
    rows = known.orderBy(F.xxhash64(id_col), id_col, *known.columns[1:]).limit(max_rows)
    kind = docs.schema[id_col].dataType.simpleString()

    def words(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = []
        for text in batch[1].to_pylist():
            n: Counter[str] = Counter()
            for word, k in Counter(_word.findall((text or "").lower())).items():
                for f in word_features(word):
                    n[f] += k
            counts.append([{"f": f, "n": k} for f, k in n.items()])
        pairs = pa.list_(pa.struct([("f", pa.string()), ("n", pa.int32())]))
        return pa.RecordBatch.from_arrays([batch[0], pa.array(counts, pairs)], names=[id_col, "words"])

    # the labelled sample is bounded by max_rows, so it may be sent to all executors
    sample = docs.select(id_col, text_col).join(F.broadcast(rows.select(id_col).distinct()), id_col, "left_semi")
    counted = map_batches(sample, words, f"`{id_col}` {kind}, words array<struct<f:string,n:int>>")
    # the hash that tells rows of one id apart is stored: beside explode it would be made again for every word
    counted = stored(counted.withColumn("words_hash", F.xxhash64("words")), "labelled-words")
    ys = known.columns[1:]
    one_each = counted.join(F.broadcast(rows), id_col).select(
        F.struct(id_col, "words_hash").alias("row"), *ys, F.explode_outer("words").alias("w"))
    one_each = one_each.select("row", *ys, F.col("w.f").alias("f"), F.col("w.n").alias("n"))
    per_feature = one_each.filter("f IS NOT NULL").groupBy("f").agg(
        F.count("*").alias("docs"), *(F.sum(y).alias(y) for y in ys))
    heads = one_each.groupBy("row", *ys).agg(F.count("*").alias("n_features")).collect()  # max_rows at most
    totals, n = [sum(r[y] for r in heads) for y in ys], len(heads)
    chosen: dict[str, None] = {}
    for y, total in zip(ys, totals, strict=True):
        if 0 < total < n:
            cross = F.col(y) * float(n) - F.col("docs") * float(total)
            score = cross * cross / (F.col("docs") * (float(n) - F.col("docs") + 1))
            best = per_feature.filter(f"docs >= {max(2, n // 1000)}").orderBy(score.desc(), "f").limit(n_features // len(ys))
            chosen |= dict.fromkeys(r["f"] for r in best.collect())
    features = sorted(chosen)

    order = sorted(range(n), key=lambda i: (str(heads[i]["row"][0]), heads[i]["row"][1]))
    row_of = {tuple(heads[i]["row"]): at for at, i in enumerate(order)}
    x = np.zeros((n, len(features)))
    if features:
        # a list of numbers (place and count in one) for each row: not an object for each feature of each row
        at = F.array_position(F.array(*map(F.lit, features)), F.col("f")) - 1
        held = one_each.filter(F.col("f").isin(features)).groupBy("row").agg(F.collect_list(F.shiftleft(at, 32) + F.col("n")).alias("w"))
        for r in held.collect():  # max_rows at most, of n_features each
            w = np.array(r["w"], np.int64)
            x[row_of[tuple(r["row"])], w >> 32] = np.log1p(w & 0xFFFFFFFF)
    y = np.array([[heads[i][c] for c in ys] for i in order], float).reshape(n, len(ys))
    fold = np.arange(n) % FOLDS
    return Chain(categories, features, fit_chain(x, y, fold))


class _Words(dict):
    """Positions of a word's features, looked up once per distinct word."""

    def __init__(self, place: dict[str, int]):
        super().__init__()
        self.place = place

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > _CACHE_LIMIT:
            self.clear()
        found = self[word] = tuple(self.place[f] for f in word_features(word) if f in self.place)
        return found


def score(df: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, and ``p_<category>`` for each category of the chain."""
    names = [f"p_{c}" for c in chain.categories]
    words = _Words({f: i for i, f in enumerate(chain.features)})

    def rate(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.zeros((batch.num_rows, len(chain.features)))
        for row, text in enumerate(batch[1].to_pylist()):
            for found in map(words.__getitem__, _word.findall((text or "").lower())):
                for f in found:
                    x[row, f] += 1
        p = chain.probabilities(np.log1p(x))
        return pa.RecordBatch.from_arrays([batch[0], *(pa.array(p[:, i]) for i in range(len(names)))],
                                          names=[id_col, *names])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, text_col), rate, f"`{id_col}` {kind}, " + ", ".join(f"`{c}` double" for c in names))


def keep_clean(df: DataFrame, chain: Chain, category: str = "toxic", threshold: float = 0.5,
               text_col: str = "text") -> DataFrame:
    """The rows whose probability of ``category`` is below ``threshold``, with all their columns."""
    words = _Words({f: i for i, f in enumerate(chain.features)})
    at = chain.categories.index(category)
    column = df.columns.index(text_col)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.zeros((batch.num_rows, len(chain.features)))
        for row, text in enumerate(batch[column].to_pylist()):
            for found in map(words.__getitem__, _word.findall((text or "").lower())):
                for f in found:
                    x[row, f] += 1
        return batch.filter(pa.array(chain.probabilities(np.log1p(x))[:, at] < threshold))

    return map_batches(df, keep, df.schema)
