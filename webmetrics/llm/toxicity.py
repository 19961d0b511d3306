"""Toxicity by a weighted grammar of small transducers over classes of words.

Words become symbols: insult, harm, intent, target, negation, reporting verb, quotation mark, other. Four
transducers rewrite them: intent before harm makes a threat; a target nearby makes an insult a targeted one; a
negation before it denies it; a reporting verb or quotation marks make it reported. Their composition reads each
clause that holds an insult or a harm word. How much each outcome weighs is learnt, and so are insults beyond the
given ones: words and beginnings of words that set toxic training texts apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textcore import ALNUM, Texts, Words, slices, words

#: Rows that lexicon and weights are learnt from at most: those with the smallest hashes of their ids.
FIT_ROWS = 20_000
#: Share of them that the lexicon is learnt from; the weights are learnt from the others.
LEXICON_SHARE = 0.75
#: Bytes of the beginnings of words that may be learnt.
STEMS = (4, 5, 6, 7, 8)
#: A learnt stem occurs in so many toxic texts at least, and so many of its texts are toxic.
LEAST_TOXIC = 6
LEAST_PRECISION = 0.85
THRESHOLD = 0.7

# Words of each class.
INSULTS = ("idiot", "idiots", "moron", "morons", "stupid", "pathetic", "disgusting", "trash", "clown", "scum", "loser", "losers", "worthless", "imbecile", "fool")
HARM = ("kill", "hurt", "destroy", "beat", "burn", "shoot", "stab", "die", "tuer", "töten", "matar")
INTENT = ("will", "gonna", "going", "shall", "should", "must", "vais", "werde", "voy")
TARGETS = ("you", "your", "yourself", "u", "he", "she", "they", "them", "him", "her", "tu", "vous", "toi", "du", "dich", "ihr", "tú", "usted", "vosotros")
NEGATIONS = ("not", "no", "never", "isn", "aren", "wasn", "don", "doesn", "nicht", "kein", "keine", "pas", "jamais", "nunca")
REPORTING = ("said", "says", "wrote", "called", "calls", "reported", "quoted", "claimed", "sagte", "schrieb", "disait", "dijo", "escribió")

OTHER, INSULT, HARMS, INTENDS, TARGET, NEGATION, REPORT, QUOTE, THREAT, TARGETED, DENIED, REPORTED = range(12)
_CLASSES = ((INSULT, INSULTS), (HARMS, HARM), (INTENDS, INTENT), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTING))
_OUTCOMES = (INSULT, TARGETED, THREAT, DENIED, REPORTED)
_SYMBOLS = 12
#: Bytes that end a clause.
_CLAUSE_END = np.zeros(256, bool)
_CLAUSE_END[[ord(c) for c in ".!?;\n"]] = True

#: Places of what a text is scored by: counts of each outcome, learnt weight, share of clauses, intercept.
FEATURES = len(_OUTCOMES) + 4


# --- transducers ------------------------------------------------------------


@dataclass
class Transducer:
    """Deterministic: from state and symbol to the next state and the symbol put out."""

    step: np.ndarray
    out: np.ndarray

    def compose(self, other: Transducer) -> Transducer:
        """First this one, then `other` on what it puts out; states are pairs that can be reached."""
        index, todo, rows = {(0, 0): 0}, [(0, 0)], []
        while todo:
            a, b = todo.pop(0)
            row = []
            for symbol in range(_SYMBOLS):
                middle = self.out[a, symbol]
                pair = (int(self.step[a, symbol]), int(other.step[b, middle]))
                if pair not in index:
                    index[pair] = len(index)
                    todo.append(pair)
                row.append((index[pair], int(other.out[b, middle])))
            rows.append(row)
        table = np.array(rows)
        return Transducer(table[:, :, 0], table[:, :, 1])

    def read(self, symbols: np.ndarray) -> list[int]:
        state, out = 0, []
        for symbol in symbols:
            out.append(int(self.out[state, symbol]))
            state = self.step[state, symbol]
        return out


def _within(trigger: int, reach: int, change: dict[int, int]) -> Transducer:
    """For `reach` symbols after `trigger`, symbols are changed."""
    step = np.maximum(np.arange(reach + 1)[:, None] - 1, 0).repeat(_SYMBOLS, 1)
    step[:, trigger] = reach
    out = np.arange(_SYMBOLS)[None, :].repeat(reach + 1, 0)
    for a, b in change.items():
        out[1:, a] = b
    return Transducer(step, out)


def _quoted() -> Transducer:
    """Between quotation marks, insults and threats are reported ones."""
    out = np.arange(_SYMBOLS)[None, :].repeat(2, 0)
    out[1, [INSULT, TARGETED, THREAT]] = REPORTED
    step = np.array([[0], [1]]).repeat(_SYMBOLS, 1)
    step[:, QUOTE] = [1, 0]
    return Transducer(step, out)


def grammar() -> Transducer:
    threat = _within(INTENDS, 3, {HARMS: THREAT})
    target = _within(TARGET, 4, {INSULT: TARGETED})
    denied = _within(NEGATION, 3, {INSULT: DENIED, TARGETED: DENIED, THREAT: DENIED})
    reported = _within(REPORT, 8, {INSULT: REPORTED, TARGETED: REPORTED, THREAT: REPORTED})
    return threat.compose(target).compose(denied).compose(reported).compose(_quoted())


# --- lexicon ----------------------------------------------------------------


def _hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(words(Texts(0, raw, np.array([0, len(raw)])), ALNUM, lower=False).hash[0])


def _stems(found: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word index, hash) of whole words and of beginnings of words that do not cut a character."""
    size = found.end - found.start
    yield np.arange(len(size)), found.hash
    for n in STEMS:
        at = np.flatnonzero(size > n)
        yield at, found.prefix_hash(at, n) ^ np.uint64(0x5851F42D4C957F2D + n)


@dataclass
class Model:
    """Classes of given words and weights of learnt stems by hash, and weights of the outcomes."""

    given: np.ndarray  # sorted hashes
    classes: np.ndarray
    learnt: np.ndarray  # sorted hashes
    strength: np.ndarray
    weights: np.ndarray

    def features(self, texts: Texts, machine: Transducer) -> np.ndarray:
        """A row of `FEATURES` numbers for each text, the last one 1."""
        found = words(texts, ALNUM, lower=False)
        symbol = np.zeros(len(found.hash), np.int64)
        strength = np.zeros(len(found.hash))
        if len(self.learnt):
            for index, value in _stems(found):
                at = np.minimum(np.searchsorted(self.learnt, value), len(self.learnt) - 1)
                hit = self.learnt[at] == value
                strength[index[hit]] = np.maximum(strength[index[hit]], self.strength[at[hit]])
        symbol[strength > 0] = INSULT
        at = np.minimum(np.searchsorted(self.given, found.hash), len(self.given) - 1)
        hit = self.given[at] == found.hash
        symbol[hit] = self.classes[at[hit]]
        strength[hit & (symbol == INSULT) & (strength == 0)] = 1.0
        out = np.zeros((len(texts), FEATURES))
        out[:, -1] = 1
        loud = np.flatnonzero((symbol == INSULT) | (symbol == HARMS))
        if not len(loud):
            return out
        ends = np.flatnonzero(_CLAUSE_END[texts.data])
        clause = np.searchsorted(ends, found.start)
        row = np.repeat(np.arange(len(texts)), np.diff(found.first))
        # A clause is the words between two clause ends within one text.
        edge = np.flatnonzero((np.diff(clause) != 0) | (np.diff(row) != 0)) + 1
        edge = np.concatenate([[0], edge, [len(symbol)]])
        for k in np.unique(np.searchsorted(edge, loud, "right") - 1):
            a, b = edge[k], edge[k + 1]
            marks = _with_quotes(texts.data, found, a, b, symbol)
            outcome = np.array(machine.read(marks[0]))
            counts = np.array([(outcome == o).sum() for o in _OUTCOMES], float)
            target = out[row[a]]
            target[: len(_OUTCOMES)] += counts
            own = strength[marks[1]] * np.isin(outcome, (INSULT, TARGETED))
            target[len(_OUTCOMES)] += own.sum()
            target[len(_OUTCOMES) + 1] = max(target[len(_OUTCOMES) + 1], own.max())
            target[len(_OUTCOMES) + 2] += bool(counts[:3].any())
        out[:, : len(_OUTCOMES) + 3] = np.log1p(out[:, : len(_OUTCOMES) + 3])
        return out


def _with_quotes(data: np.ndarray, found: Words, a: int, b: int, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of words a to b with quotation marks between them, and the word each belongs to."""
    start, end = found.start[a], found.end[b - 1]
    quotes = start + np.flatnonzero(data[start:end] == ord('"'))
    if not len(quotes):
        return symbol[a:b], np.arange(a, b)
    at = np.concatenate([found.start[a:b], quotes])
    order = np.argsort(at, kind="stable")
    kinds = np.concatenate([symbol[a:b], np.full(len(quotes), QUOTE)])
    return kinds[order], np.concatenate([np.arange(a, b), np.full(len(quotes), a)])[order]


# --- fitting and scoring ----------------------------------------------------


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression by Newton steps; the last column is not penalised."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * max(1, len(x)) / 100)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - penalty * w
        curvature = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty)
        change = np.linalg.solve(curvature, gradient)
        w += change
        if np.abs(change).max() < 1e-6:
            break
    return w


def _sample(docs: DataFrame, labels: DataFrame, train: Column, id_column: str, text_column: str, label_column: str, most: int) -> tuple[DataFrame, int]:
    rows = labels.where(train & F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
    rows = rows.groupBy(F.col(id_column).cast("long").alias("doc_id")).agg(F.max(label_column).cast("int").alias("label"))
    kept = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()  # bounded by `most`
    session = docs.sparkSession
    small = session.createDataFrame([(r["doc_id"], r["label"]) for r in kept], "doc_id long, label int")
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return texts.join(F.broadcast(small), "doc_id"), len(kept)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    most: int = FIT_ROWS,
) -> Model:
    """Learns from the texts of at most `most` rows of `labels` with `train`, which may use the id.

    Repeated labels of an id count as toxic if one is. Rows whose text is null count as empty. With no labelled
    row, or labels of one kind only, scores are the same for all texts that the given words do not tell apart.
    """
    pairs = {_hash(w): kind for kind, own in _CLASSES for w in own}
    given = np.array(sorted(pairs), np.uint64)
    model = Model(given, np.array([pairs[int(h)] for h in given]), np.zeros(0, np.uint64), np.zeros(0), np.zeros(FEATURES))
    sample, n = _sample(docs, labels, train, id_column, text_column, label_column, most)
    if not n:
        return model
    part = F.pmod(F.hash("doc_id"), F.lit(100)) < int(100 * LEXICON_SHARE)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for texts in slices(pc.utf8_lower(batch.column(0))):
                found = words(texts, ALNUM, lower=False)
                row = np.repeat(np.arange(len(texts)), np.diff(found.first))
                for index, value in _stems(found):
                    order = np.lexsort((row[index], value))
                    value, own = value[order], row[index][order]
                    new = np.ones(len(value), bool)
                    new[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
                    value, toxic = value[new], label[texts.first + own[new]] == 1
                    stem, first = np.unique(value, return_index=True)
                    if len(stem):
                        yield pa.RecordBatch.from_arrays([pa.array(stem.view(np.int64)), pa.array(np.add.reduceat(toxic.astype(np.int64), first)), pa.array(np.diff(np.append(first, len(value))), pa.int64())], ["stem", "toxic", "n"])

    stems = sample.where(part).select("text", "label").mapInArrow(counted, "stem long, toxic long, n long")
    stems = stems.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    rows = stems.where((F.col("toxic") >= LEAST_TOXIC) & (F.col("toxic") >= LEAST_PRECISION * F.col("n"))).collect()  # bounded by the sample
    learnt = np.array([r["stem"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(learnt)
    model.learnt = learnt[order]
    model.strength = np.array([np.log2((r["toxic"] + 0.5) / (r["n"] - r["toxic"] + 0.5)) for r in rows])[order]

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = grammar()
        for batch in batches:
            for texts in slices(pc.utf8_lower(batch.column(0))):
                x = model.features(texts, machine)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1).slice(texts.first, len(texts))], ["x", "label"])

    rows = sample.where(~part).select("text", "label").mapInArrow(described, "x array<double>, label int").collect()
    if rows:
        model.weights = logistic(np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float))
    return model


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row; null and empty texts are scored as texts that hold nothing."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = grammar()
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for texts in slices(pc.utf8_lower(batch.column(1))):
                x = model.features(texts, machine)
                out[texts.first : texts.first + len(texts)] = 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), pa.array((out >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(scored, "doc_id long, score double, predicted int")
