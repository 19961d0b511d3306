"""Language of a text: blended-spectrum presence kernel, Nyström landmarks, one-versus-rest kernel ridge regression.

Two texts are as similar as the byte n-grams (1 to 4 long) that both contain, counted once each, over the root
of the product of how many each contains. The kernel is linear in the indicator vectors of n-grams, so landmark
similarities and ridge weights fold into one matrix with a row per n-gram bucket and a column per language, and
documents are scored by products of their indicator matrix with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .textcore import Texts, slices

UNKNOWN = "und"
ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 16
#: Training rows and landmarks of each language at most: the bounded sample that the model is fitted on.
ROWS_PER_LANGUAGE = 300
LANDMARKS_PER_LANGUAGE = 64
RIDGE = 1e-2
#: Turns differences of ridge outputs (targets -1 and 1) into a score from 0 to 1.
SHARPNESS = 3.0
#: A document is rejected below this score.
LEAST_SCORE = 0.3

_BATCH = 32  # documents whose indicator vectors are held at once
_SLICE = 1 << 18  # bytes of text whose n-grams are held at once, in some 30 times as many bytes
_LETTERS = np.full(256, 0x20, np.uint8)  # letters in lower case, all else a blank
_LETTERS[0x80:] = np.arange(0x80, 0x100)
_LETTERS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTERS[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # n-gram bucket x language


def _has_letter(texts: Texts) -> np.ndarray:
    """Whether each row has a letter of any script."""
    ascii_letter = (_LETTERS[texts.data] != 0x20) & (texts.data < 0x80)
    total = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = total[texts.offsets[1:]] > total[texts.offsets[:-1]]
    for k in np.flatnonzero(~out):
        raw = texts.data[texts.offsets[k] : texts.offsets[k + 1]].tobytes()
        out[k] = any(c.isalpha() for c in raw.decode("utf-8", "replace"))
    return out


def _indicators(texts: Texts) -> Iterator[tuple[int, np.ndarray]]:
    """Indicator rows of `_BATCH` texts at a time, and the first text's index."""
    data = _LETTERS[texts.data].astype(np.uint32)
    buckets, code = [], np.zeros(len(data), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        code = (code[: max(0, len(data) - n + 1)] << np.uint32(8)) | data[n - 1 :]
        if n in ORDERS:
            value = (code + np.uint32(n * 0x51ED27)) * np.uint32(2654435761)
            buckets.append((n, (value ^ (value >> np.uint32(13))) * np.uint32(0x85EBCA6B) >> np.uint32(16)))
    for first in range(0, len(texts), _BATCH):
        rows = np.zeros((min(_BATCH, len(texts) - first), BUCKETS), np.uint8)
        for k in range(len(rows)):
            a, b = texts.offsets[first + k], texts.offsets[first + k + 1]
            for n, bucket in buckets:
                rows[k][bucket[a : max(a, b - n + 1)]] = 1
        yield first, rows


def _training_bits(docs: DataFrame) -> DataFrame:
    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(0), _SLICE):
                letters = _has_letter(texts)
                for first, rows in _indicators(texts):
                    at = np.flatnonzero(letters[first : first + len(rows)])
                    packed = [np.packbits(rows[k]).tobytes() for k in at]
                    yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(texts.first + first + at)), pa.array(packed, pa.binary())], ["lang", "bits"])

    return docs.select("text", "lang").mapInArrow(bits, "lang string, bits binary")


def fit(
    docs: DataFrame,
    train: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    rows_per_language: int = ROWS_PER_LANGUAGE,
    landmarks_per_language: int = LANDMARKS_PER_LANGUAGE,
    ridge: float = RIDGE,
) -> Model:
    """A model of the languages that rows with `train` name; `train` may use any column of `docs`.

    The sample has `rows_per_language` rows of each language, those with the smallest hashes of their ids; only
    it reaches the driver. The first rows of each language's sample are its landmarks. Null languages, null texts and
    texts without letters teach nothing. Without any row left, no language is known.
    """
    known = docs.where(train).select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang"))
    known = known.where("lang is not null and text is not null and text rlike '\\\\p{L}'")
    narrow = known.select("id", "lang", F.xxhash64("id").alias("hash"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("hash", "id"))
    ids = [r["id"] for r in narrow.withColumn("rank", rank).where(F.col("rank") <= rows_per_language).select("id").collect()]
    sample = _training_bits(known.where(F.col("id").isin(sorted({x for x in ids if x is not None})))).collect() if ids else []
    languages = sorted({r["lang"] for r in sample})
    if not sample:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    sample.sort(key=lambda r: (r["lang"], bytes(r["bits"])))
    packed = np.array([np.frombuffer(r["bits"], np.uint8) for r in sample])
    label = np.array([languages.index(r["lang"]) for r in sample])
    size = np.bitwise_count(packed).sum(1, dtype=np.int64).astype(float)
    seen: dict[int, int] = {}
    marks = []
    for k in np.random.default_rng(7).permutation(len(sample)):
        if seen.setdefault(int(label[k]), 0) < landmarks_per_language:
            seen[int(label[k])] += 1
            marks.append(k)
    marks = np.array(sorted(marks))
    kernel = np.array([np.bitwise_count(packed & packed[m]).sum(1, dtype=np.int64) for m in marks], float).T
    kernel /= np.sqrt(size[:, None] * size[marks][None, :])
    value, vector = np.linalg.eigh(kernel[marks])
    good = value > 1e-8 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    features = kernel @ root
    weight = 1.0 / np.bincount(label)[label]  # each language counts alike
    target = np.where(label[:, None] == np.arange(len(languages)), 1.0, -1.0)
    scaled = features * weight[:, None]
    coefficients = np.linalg.solve(features.T @ scaled + ridge * np.eye(features.shape[1]), scaled.T @ target)
    folded = (root @ coefficients) / np.sqrt(size[marks])[:, None]
    weights = np.zeros((BUCKETS, len(languages)))
    for m, row in zip(marks, folded, strict=True):
        weights[np.unpackbits(packed[m]).astype(bool)] += row
    return Model(languages, weights.astype(np.float32))


def _scorer(model: Model, text_column: str):
    """Batches with the columns `lang_pred` and `score` added."""
    languages, weights = np.array([*model.languages, UNKNOWN], object), model.weights

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pick = np.full(batch.num_rows, len(languages) - 1)
            score = np.zeros(batch.num_rows)
            for texts in slices(batch.column(text_column), _SLICE) if len(languages) > 1 else ():
                letters = _has_letter(texts)
                for first, rows in _indicators(texts):
                    own = letters[first : first + len(rows)]
                    size = np.maximum(rows.sum(1, dtype=np.int64), 1)
                    output = rows.astype(np.float32) @ weights / np.sqrt(size)[:, None]
                    power = np.exp(SHARPNESS * (output - output.max(1, keepdims=True)).astype(float))
                    at = texts.first + first + np.flatnonzero(own)
                    pick[at] = output.argmax(1)[own]
                    score[at] = (power.max(1) / power.sum(1))[own]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(languages[pick], pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    return scored


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row; null texts, texts without letters and unfitted models give `und` and 0."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    scored = _scorer(model, "text")

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scored(batches):
            yield batch.drop_columns(["text"])

    return rows.mapInArrow(narrow, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, text_column: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """Rows of `docs`, all columns, whose language is known and whose score is `least` at least.

    Rows stay where they are: nothing is shuffled or joined, so null and repeated ids make no difference.
    """
    scored = _scorer(model, text_column)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scored(batches):
            lang, score = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            keep = (np.array(lang.to_pylist(), object) != UNKNOWN) & (score.to_numpy(zero_copy_only=False) >= least)
            yield pa.RecordBatch.from_arrays(batch.columns[:-2], batch.schema.names[:-2]).filter(pa.array(keep))

    return docs.mapInArrow(kept, docs.schema)
