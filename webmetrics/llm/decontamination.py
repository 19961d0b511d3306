"""Benchmark passages in training documents: spaced seeds, then a check of the words around each hit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILTER_BITS, cut, filter_bit, free_name, member_bits
from .textcore import ALNUM, Texts, Words, runs_of, slices, words

#: Fixed masks, 1 = the word counts. Of any 13 words with 2 replaced, of any 12 or 11 with 1 replaced, at least
#: one mask at one place meets none of the replaced words (tests/llm checks all patterns).
MASKS = ("1111101", "1011000111")
#: Words of a passage that is compared; a shorter benchmark item is compared as a whole.
WINDOW = 13
#: Benchmark items with fewer words are no evidence and are not searched.
LEAST_WORDS = 11
#: Share of words that must be equal, place by place.
SHARE = 0.84

HITS = "doc_id long, item_id long, start long, end long, matched int, compared int"


def _columns(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column)


def _sizes(found: Words) -> np.ndarray:
    return np.diff(found.first)


def _seeds(texts: Texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Words]]:
    """For each mask: hashes, rows and word positions of all places where it fits within a row."""
    found = words(texts, ALNUM, lower=False)
    n = len(found.hash)
    row = np.repeat(np.arange(len(texts)), _sizes(found))
    position = np.arange(n) - found.first[row]
    left = found.first[row + 1] - np.arange(n)
    for mask in MASKS:
        hashes = runs_of(found, len(mask), [int(c) for c in mask])
        fits = np.flatnonzero(left[: len(hashes)] >= len(mask))
        yield hashes[fits], row[fits], position[fits], found


def seeds(df: DataFrame, id_column: str, text_column: str, bits: bytes | None = None, least: int = 0) -> DataFrame:
    """Rows (hash, id, position, words) of every mask at every place of every text with `least` words.

    `bits`: only hashes that a membership filter lets pass.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passing = np.frombuffer(bits, np.uint8) if bits is not None else None
        for batch in batches:
            for texts in slices(_lowered(batch.column(1))):
                for hashes, row, position, own in _seeds(texts):
                    size = _sizes(own)[row]
                    keep = size >= least
                    if passing is not None:
                        bit = hashes & np.uint64(FILTER_BITS - 1)
                        keep &= (passing[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
                    at = np.flatnonzero(keep)
                    if len(at):
                        ids = batch.column(0).take(pa.array(texts.first + row[at]))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(hashes[at].view(np.int64)), ids, pa.array(position[at], pa.int64()), pa.array(size[at], pa.int64())],
                            ["hash", "id", "position", "words"],
                        )

    return _columns(df, id_column, text_column).where("id is not null").mapInArrow(found, "hash long, id long, position long, words long")


def _best(doc: np.ndarray, item: np.ndarray, shift: int, window: int, share: float) -> tuple[int, int, int, int] | None:
    """Best stretch of `window` places of `item` laid `shift` words into `doc`, widened over all that qualify.

    (first word in doc, last word + 1, equal words, places) or None.
    """
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    size = min(window, len(item))
    if high - low < size:
        return None
    same = doc[low + shift : high + shift] == item[low:high]
    total = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(total[size:] - total[:-size] >= np.ceil(share * size - 1e-9))
    if not len(good):
        return None
    first, last = int(good[0]), int(good[-1]) + size
    return low + shift + first, low + shift + last, int(total[last] - total[first]), last - first


def _verified(window: int, share: float):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            texts, items = _lowered(batch.column("text")), _lowered(batch.column("item_text"))
            for k in range(batch.num_rows):
                doc_words, spans = _split(texts[k].as_py())
                item_words, _ = _split(items[k].as_py())
                index: dict[bytes, int] = {}
                doc = np.array([index.setdefault(w, len(index)) for w in doc_words], np.int64)
                item = np.array([index.setdefault(w, len(index)) for w in item_words], np.int64)
                found = [x for s in batch.column("shifts")[k].as_py() if (x := _best(doc, item, s, window, share))]
                if found:
                    first, last, same, places = max(found, key=lambda x: (x[2], -x[0]))
                    rows.append((batch.column("doc_id")[k].as_py(), batch.column("item_id")[k].as_py(), spans[first][0], spans[last - 1][1], same, places))
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "item_id", "start", "end", "matched", "compared"), r, strict=True)) for r in rows], schema=_HIT_SCHEMA)

    return check


_HIT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("matched", pa.int32()), ("compared", pa.int32())])


def _split(text: str | None) -> tuple[list[bytes], list[tuple[int, int]]]:
    """Words of a lowered text and their places in code points."""
    raw = (text or "").encode()
    texts = Texts(0, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    found = words(texts, ALNUM, lower=False)
    point = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
    return [raw[a:b] for a, b in zip(found.start, found.end, strict=True)], list(zip(point[found.start].tolist(), point[found.end].tolist(), strict=True))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    share: float = SHARE,
) -> DataFrame:
    """Rows of `HITS`: each document with each benchmark item it repeats, and the best place in code points.

    Words are runs of letters and digits, lower case. An item is repeated where `share` of `window` words in a
    row (of all its words, if it has fewer) stand in the document in the same order without gaps; words may be
    replaced, not inserted. Places are found by the masks: hashes of both sides are joined, document hashes
    having passed a membership filter of fixed size before, and each joined alignment is checked word by word.

    Null or empty texts on either side match nothing, nor do rows with a null id. Equal items are all named.
    Of rows with one id, either may supply the place. Empty tables give no rows; other columns are ignored.
    """
    item_seeds = cut(seeds(benchmark, item_id, item_text, least=LEAST_WORDS))
    bits = member_bits(item_seeds, F.col("hash"))
    doc_seeds = seeds(docs, id_column, text_column, bits)
    pairs = doc_seeds.alias("d").join(item_seeds.alias("b"), "hash")
    shift = (F.col("d.position") - F.col("b.position")).cast("int").alias("shift")
    pairs = pairs.select(F.col("d.id").alias("doc_id"), F.col("b.id").alias("item_id"), shift).distinct()
    pairs = cut(pairs.groupBy("doc_id", "item_id").agg(F.collect_list("shift").alias("shifts")))
    hit = member_bits(pairs, F.xxhash64("doc_id"))
    texts = _columns(docs, id_column, text_column).select(F.col("id").alias("doc_id"), "text", filter_bit(F.xxhash64("id")).alias("bit"))
    texts = texts.where("doc_id is not null").mapInArrow(_passing(hit), "doc_id long, text string")
    items = _columns(benchmark, item_id, item_text).select(F.col("id").alias("item_id"), F.col("text").alias("item_text"))
    joined = texts.join(pairs.join(items, "item_id"), "doc_id")
    found = joined.select("doc_id", "item_id", "text", "item_text", "shifts").mapInArrow(_verified(window, share), HITS)
    best = F.max_by(F.struct("start", "end", "matched", "compared"), F.struct("matched", -F.col("start"), -F.col("end")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def _passing(bits: bytes):
    """Rows whose column `bit` is set in `bits`, without that column."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits, np.uint8)
        for batch in batches:
            bit = batch.column("bit").to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array((table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0)).drop_columns(["bit"])

    return keep


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", **options: object) -> DataFrame:
    """`docs`, all columns, without the documents that repeat a benchmark item; null ids stay."""
    hit = free_name(docs, "_hit")
    hits = contaminated(docs, benchmark, id_column, **options).select(F.col("doc_id").alias(hit)).distinct()
    return docs.join(cut(hits), F.col(id_column) == F.col(hit), "left_anti")
