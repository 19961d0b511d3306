"""Quality by co-training: a view of the text and a view of the metadata teach each other.

Each document becomes two short vectors once, kept in the checkpoint folder. A view's logistic regression is
fitted over all labelled rows and, from the second round on, over all unlabelled rows that the other view is
sure of. Newton steps sum their gradients in tasks and in Spark; only a matrix the size of a view squared
reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, remainder
from .textcore import LOWER, NOT_SPACE, Texts, slices, words

ROUNDS = 3
NEWTON_STEPS = 4
#: A view teaches the other what it gives at least this calibrated probability, either way.
SURE = 0.97
#: Weight of a pseudo-label beside a label's 1.
PSEUDO_WEIGHT = 0.3
#: One labelled row in so many is held back for calibration.
CALIBRATION_PART = 5
RIDGE = 1.0
KEEP = 0.5
#: Buckets that sources and languages are hashed into.
SOURCE_BUCKETS, LANG_BUCKETS = 32, 8

TEXT_VIEW = 17
META_VIEW = SOURCE_BUCKETS + LANG_BUCKETS + 4


def _sums(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def text_features(texts: Texts) -> np.ndarray:
    """Shares of kinds of characters, words and lines, and how often they repeat; a row of `TEXT_VIEW` for each text."""
    data, offsets = texts.data, texts.offsets
    size = np.maximum(np.diff(offsets).astype(float), 1)
    lower = LOWER[data]
    letter = ((lower >= ord("a")) & (lower <= ord("z"))) | (data >= 0x80)
    upper = (data >= ord("A")) & (data <= ord("Z"))
    digit = (data >= ord("0")) & (data <= ord("9"))
    stop = np.isin(data, np.frombuffer(b".,!?;:'\"-()", np.uint8))
    symbol = NOT_SPACE[data] & ~letter & ~digit & ~stop
    line_end = data == ord("\n")
    lines = np.zeros(256, bool)
    lines[:] = True
    lines[ord("\n")] = False
    found, rows = words(texts), words(texts, lines)
    n_words, n_lines = np.diff(found.first).astype(float), np.diff(rows.first).astype(float)
    length = (found.end - found.start).astype(np.int64)
    word_edges = found.first
    out = np.zeros((len(texts), TEXT_VIEW))
    for k, mark in enumerate((letter, upper, digit, stop, symbol, line_end, data >= 0x80)):
        out[:, k] = _sums(mark, offsets) / size
    out[:, 7] = _sums(data == ord("!"), offsets) / np.maximum(n_words, 1)
    out[:, 8] = _sums(length, word_edges) / np.maximum(n_words, 1) / 10
    out[:, 9] = _sums(length <= 3, word_edges) / np.maximum(n_words, 1)
    out[:, 10] = _sums(length >= 14, word_edges) / np.maximum(n_words, 1)
    for k in range(len(texts)):
        own, line = found.hash[found.first[k] : found.first[k + 1]], rows.hash[rows.first[k] : rows.first[k + 1]]
        if len(own):
            counts = np.unique(own, return_counts=True)[1]
            out[k, 11], out[k, 12] = len(counts) / len(own), counts.max() / len(own)
            out[k, 13] = len(counts) / np.sqrt(len(own)) / 10
        if len(line):
            out[k, 14] = len(np.unique(line)) / len(line)
    out[:, 15] = np.log1p(n_words) / 10
    out[:, 16] = np.log1p(n_lines) / 5
    return out


def features(docs: DataFrame, id_column: str, text_column: str, source_column: str, lang_column: str, size_column: str) -> DataFrame:
    """(doc_id, text_view, meta_view); metadata never uses the text."""

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = np.zeros((batch.num_rows, TEXT_VIEW))
            for texts in slices(batch.column(1)):
                text[texts.first : texts.first + len(texts)] = text_features(texts)
            at = np.arange(batch.num_rows)
            meta = np.zeros((batch.num_rows, META_VIEW))
            meta[at, batch.column(2).to_numpy(zero_copy_only=False)] = 1
            meta[at, SOURCE_BUCKETS + batch.column(3).to_numpy(zero_copy_only=False)] = 1
            chars = np.nan_to_num(batch.column(4).to_numpy(zero_copy_only=False).astype(float))
            size = np.log1p(np.maximum(chars, 0)) / 10
            meta[:, -4:] = np.stack([size, size**2, chars < 200, chars > 20_000], 1)
            lists = [pa.array(list(v.astype(np.float32)), pa.list_(pa.float32())) for v in (text, meta)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["doc_id", "text_view", "meta_view"])

    bucket = lambda c, n: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(n)).cast("int")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), bucket(source_column, SOURCE_BUCKETS).alias("s"), bucket(lang_column, LANG_BUCKETS).alias("l"), F.coalesce(F.col(size_column).cast("double"), F.lit(0.0)).alias("n"))
    return rows.mapInArrow(described, "doc_id long, text_view array<float>, meta_view array<float>")


@dataclass
class View:
    """A linear model of one view, and the line that turns its margins into log odds."""

    name: str
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:-1] + self.weights[-1]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.margin(x) + self.shift)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float)


def _newton_step(rows: DataFrame, w: np.ndarray, inputs, ridge: float) -> np.ndarray:
    """`w` after one step; `inputs` gives x, y and weights of a batch. Sums of d^2 + d numbers reach the driver."""
    d = len(w)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d * d + d)
        for batch in batches:
            x, y, weight = inputs(batch)
            x = np.hstack([x, np.ones((len(x), 1))])
            p = _sigmoid(x @ w)
            total[: d * d] += ((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x).ravel()
            total[d * d :] += x.T @ (weight * (y - p))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "v"])

    sums = np.zeros(d * d + d)
    for row in rows.mapInArrow(parts, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        sums[row["k"]] = row["v"]
    penalty = np.full(d, ridge)
    penalty[-1] = 1e-3
    return w + np.linalg.solve(sums[: d * d].reshape(d, d) + np.diag(penalty), sums[d * d :] - penalty * w)


def _fit(rows: DataFrame, d: int, inputs, ridge: float = RIDGE, start: np.ndarray | None = None) -> np.ndarray:
    w = np.zeros(d + 1) if start is None else start
    for _ in range(NEWTON_STEPS):
        w = _newton_step(rows, w, inputs, ridge)
    return w


def _taught(view: str, other: View | None):
    """Labels and, of unlabelled rows, what the other view is sure of."""

    def inputs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        label = batch.column("label").to_numpy(zero_copy_only=False).astype(float)  # NaN where unlabelled
        x, weight = _matrix(batch, view), np.where(np.isnan(label), 0.0, 1.0)
        y = np.nan_to_num(label)
        if other is not None:
            p = other.probability(_matrix(batch, other.name))
            sure = np.isnan(label) & ((p >= SURE) | (p <= 1 - SURE))
            y[sure], weight[sure] = (p[sure] >= 0.5).astype(float), PSEUDO_WEIGHT
        return x, y, weight

    return inputs


def _calibration(views: list[View]):
    """Margins of views as inputs, over labelled rows."""

    def inputs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        label = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
        x = np.stack([v.slope * v.margin(_matrix(batch, v.name)) + v.shift for v in views], 1)
        return x, np.nan_to_num(label), np.where(np.isnan(label), 0.0, 1.0)

    return inputs


@dataclass
class Model:
    views: list[View]
    combination: np.ndarray  # of the calibrated log odds of each view, and the intercept


def co_train(rows: DataFrame, rounds: int = ROUNDS) -> Model:
    """`rows`: text_view, meta_view, label (null: unlabelled) and `held` for labelled rows kept for calibration."""
    learn, held = rows.where("not held"), rows.where("held and label is not null")
    dims = {"text_view": TEXT_VIEW, "meta_view": META_VIEW}
    views: dict[str, View] = {}
    for _ in range(max(1, rounds)):
        before = dict(views)
        for name, d in dims.items():
            other = next((v for v in before.values() if v.name != name), None)
            pool = learn if other else learn.where("label is not null")
            start = before[name].weights if name in before else None
            view = View(name, _fit(pool, d, _taught(name, other), start=start))
            line = _fit(held, 1, _calibration([view]), ridge=1e-2)
            views[name] = View(name, view.weights, float(line[0]), float(line[1]))
    order = [views[name] for name in dims]
    return Model(order, _fit(held, len(order), _calibration(order), ridge=1e-2))


def quality(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    lang_column: str = "lang",
    size_column: str = "n_chars",
    label_column: str = "quality",
    rounds: int = ROUNDS,
    keep: float = KEEP,
) -> DataFrame:
    """(doc_id, score, text_score, meta_score, keep) of every row of `docs`.

    Labels are joined by id; of contradicting labels of one id, the lower counts. Null text counts as empty, null
    metadata as a value of its own, null ids as unlabelled. Without any label all scores are one half, and are kept.
    """
    narrow = features(docs, id_column, text_column, source_column, lang_column, size_column)
    known = labels.groupBy(F.col(id_column).cast("long").alias("doc_id")).agg(F.min(label_column).cast("double").alias("label"))
    held: Column = remainder("doc_id", CALIBRATION_PART) == 0
    rows = cut(narrow.join(known, "doc_id", "left").withColumn("held", held & F.col("label").isNotNull()))
    model = co_train(rows, rounds)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = np.stack([v.slope * v.margin(_matrix(batch, v.name)) + v.shift for v in model.views], 1)
            score = _sigmoid(odds @ model.combination[:-1] + model.combination[-1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(_sigmoid(odds[:, 0])), pa.array(_sigmoid(odds[:, 1])), pa.array(score >= keep)], ["doc_id", "score", "text_score", "meta_score", "keep"])

    return rows.mapInArrow(scored, "doc_id long, score double, text_score double, meta_score double, keep boolean")
