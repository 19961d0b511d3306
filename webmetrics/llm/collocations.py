"""Phrases whose words occur together more often than their parts suggest, per language.

Tasks number the words of about `SHARD_WORDS` words of text and write a bidirectional FM-index of them: that is a
shard. Phrases grow a level at a time. Each shard enumerates extensions of what is still frequent by interval
extension and returns counts; Spark sums them over all shards, and the frequent ones go back to the shards that have
them, through a join by shard. A phrase cannot be more frequent than its parts, so nothing is lost and the rest is
never counted. No list of words or phrases is broadcast or reaches the driver.

Words are identified over all shards by the first (shard, number) that has them, which is exact, unlike a hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .fm_index import BREAK, Index, transform

#: Occurrences of a candidate, and phrases returned per language.
LEAST, BEST = 30, 2000
#: A longer candidate that has so many percent of a phrase's occurrences replaces it.
CONTAINED = 80
#: Words of a shard; a single text may make it longer.
SHARD_WORDS = 1 << 21
#: Text that is split at once, unless a single one is longer.
SLICE_BYTES = 1 << 22

# A word's number: 20 bits of the task, 14 of its shards, 29 of the shard's words.
_TASK_BITS, _WORD_BITS = 14, 29

#: Pairs of about so many words of text are summed by one task.
BUCKET_WORDS = 1 << 21

_SHARDS = "shard long, langs array<string>, words array<string>, counts array<long>, sizes binary, forward binary, backward binary"


def _packed(numbers: np.ndarray) -> bytes:
    data = numbers.astype(np.int32).tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], size, "zstd", asbytes=True), np.int32)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, lower-cased in ASCII, a line feed between pieces and behind texts; and the text of each."""
    texts = pc.ascii_lower(texts.cast(pa.large_string()))
    texts = pc.replace_substring_regex(texts, r"[.,;:!?\x0A-\x0D]", " \n ")
    texts = pc.binary_join_element_wise(pc.replace_substring(texts, "\t", " "), pa.scalar("\n", pa.large_string()), pa.scalar(" ", pa.large_string()))
    lists = pc.split_pattern(texts, " ")
    return lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))


class _Shard:
    """Word numbers of consecutive texts, from 1 on, by language and word."""

    def __init__(self):
        self.numbers: dict[tuple[str, str], int] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, langs: pa.Array, texts: pa.Array) -> None:
        words, of = split_words(texts)
        words, langs = words.dictionary_encode(), langs.dictionary_encode()
        code = words.indices.to_numpy().astype(np.int64)
        lang = langs.indices.to_numpy()[of].astype(np.int64)
        known, spoken = words.dictionary.to_pylist(), langs.dictionary.to_pylist()
        special = np.array([2 if w == "" else w == "\n" for w in known], np.int8)[code] if len(code) else code
        code, lang, special = code[special != 2], lang[special != 2], special[special != 2]
        pairs, place = np.unique(lang * len(known) + code, return_inverse=True)
        new = np.empty(len(pairs), np.int64)
        for k, pair in enumerate(pairs.tolist()):
            word = known[pair % len(known)]
            new[k] = BREAK if word == "\n" else self.numbers.setdefault((spoken[pair // len(known)], word), len(self.numbers) + 1)
        found = new[place] if len(pairs) else code
        repeated = (found == BREAK) & (np.concatenate(([BREAK], found[:-1])) == BREAK)
        self.parts.append(found[~repeated].astype(np.int32))
        self.size += len(self.parts[-1])

    def row(self, shard: int) -> dict:
        words = np.concatenate([np.array([BREAK], np.int32), *self.parts])
        counts = np.bincount(words, minlength=len(self.numbers) + 1)
        langs, names = zip(*self.numbers) if self.numbers else ((), ())
        return {"shard": shard, "langs": langs, "words": names, "counts": counts.tolist(), "sizes": _packed(counts),
                "forward": _packed(transform(words)), "backward": _packed(transform(words[::-1]))}


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        until = max(at + 1, int(np.searchsorted(ends, done + SLICE_BYTES, "right")))
        # Copies: some of Arrow's text functions read slices of an array at wrong places.
        yield batch.take(pa.array(range(at, until)))
        at = until


def shards(docs: DataFrame) -> DataFrame:
    """Indexes of all words of `docs`, kept in the shared folder: a row a shard."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int64()), ("langs", pa.list_(pa.string())), ("words", pa.list_(pa.string())),
                            ("counts", pa.list_(pa.int64())), ("sizes", pa.binary()), ("forward", pa.binary()), ("backward", pa.binary())])
        task, shard, made = TaskContext.get().partitionId(), _Shard(), 0

        def done() -> pa.RecordBatch:
            nonlocal shard, made
            if made >> _TASK_BITS or len(shard.numbers) >> _WORD_BITS:
                raise ValueError("too many shards in a task, or words in a shard: use more partitions")
            row = shard.row(task << _TASK_BITS | made)
            shard, made = _Shard(), made + 1
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for part in _slices(batch):
                shard.add(part.column(0), part.column(1))
                if shard.size >= SHARD_WORDS:
                    yield done()
        if shard.size:
            yield done()

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return stored(rows.mapInArrow(build, _SHARDS), "shards")


def _block(*columns: np.ndarray) -> bytes:
    """Columns of equal length, each as planes of bytes: the high ones are mostly zero, or alike."""
    planes = [np.ascontiguousarray(c.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns]
    data = b"".join(planes)
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _columns(block: bytes, count: int) -> list[np.ndarray]:
    data = np.frombuffer(pa.decompress(block[8:], int.from_bytes(block[:8], "little"), "zstd", asbytes=True), np.uint8)
    return [np.ascontiguousarray(c.reshape(8, -1).T).view(np.int64).ravel() for c in np.split(data, count)]


_BLOCK = pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("block", pa.binary())])
_SUMMED = pa.schema([*_BLOCK, ("w1", pa.int64()), ("w2", pa.int64()), ("f", pa.int64())])
_LONGER = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("w3", pa.int64()), ("w4", pa.int64()), ("n", pa.int64())])


class _Pairs:
    """Pairs of frequent words of a shard, by bucket; made anew they have the same order."""

    def __init__(self, fm: Index, number: np.ndarray, buckets: int):
        last = np.flatnonzero(number >= 0)
        found = fm.left(fm.words(last))
        found = found[number[found.word] >= 0]
        first, last = found.word, last[found.of]
        numbers = number.astype(np.uint64)
        mixed = (numbers[first] * np.uint64(0x9E3779B97F4A7C15) + numbers[last]) * np.uint64(0xD6E8FEB86659FD93)
        bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        self.first, self.last, self.phrases = first[order], last[order], found.phrases[order]
        self.begins = np.searchsorted(bucket[order], np.arange(buckets + 1))


def _blocks_of_shard(buckets: int):
    """A block (numbers over all shards, and count) of the pairs of each bucket, and one of the words' numbers.

    The latter comes in a bucket of its own, below zero.
    """
    def blocks(index: pa.Table, words: pa.Table) -> pa.Table:
        if not index.num_rows or not words.num_rows:
            return _BLOCK.empty_table()
        shard, counts = index["shard"][0].as_py(), _unpacked(index["sizes"][0].as_py())
        number = np.full(len(counts), -1, np.int64)
        number[words["local"].to_numpy()] = words["word"].to_numpy()
        pairs = _Pairs(Index(counts, _unpacked(index["forward"][0].as_py())), number, buckets)
        rows = [(-1 - shard, shard, _block(number))]
        for bucket in range(buckets):
            at = slice(pairs.begins[bucket], pairs.begins[bucket + 1])
            if at.start < at.stop:
                rows.append((bucket, shard, _block(number[pairs.first[at]], number[pairs.last[at]], pairs.phrases.count[at])))
        return pa.table(list(zip(*rows)), schema=_BLOCK) if rows else _BLOCK.empty_table()

    return blocks


def _summed_bucket(least: int):
    """Sums of a bucket's pairs over all shards: those with `least`, and for each shard which of its pairs these are."""
    def summed(blocks: pa.Table) -> pa.Table:
        nothing = [pa.nulls(blocks.num_rows, pa.int64())] * 3
        if blocks["bucket"][0].as_py() < 0:
            return pa.table([*blocks.columns, *nothing], schema=_SUMMED)
        parts = [_columns(b.as_py(), 3) for b in blocks["block"]]
        w1, w2, n = (np.concatenate(c) for c in zip(*parts))
        firsts, first = np.unique(w1, return_inverse=True)
        seconds, second = np.unique(w2, return_inverse=True)
        key = first * len(seconds) + second
        order = np.argsort(key)
        begins = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
        total = np.add.reduceat(n[order], begins)
        often = total >= least
        chosen = np.empty(len(key), bool)
        chosen[order] = np.repeat(often, np.diff(np.append(begins, len(key))))
        ends = np.cumsum([len(p[0]) for p in parts])
        masks = [np.packbits(c).tobytes() for c in np.split(chosen, ends[:-1])]
        found = order[begins[often]]
        none = len(found)
        return pa.concat_tables([
            pa.table([blocks["bucket"], blocks["shard"], pa.chunked_array([pa.array(masks, pa.binary())]), *nothing], schema=_SUMMED),
            pa.table([pa.nulls(none, pa.int64()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.binary()), w1[found], w2[found], total[often]], schema=_SUMMED)])

    return summed


def _longer_of_shard(buckets: int):
    """Phrases of three and four words all of whose pairs are frequent (w4 null in those of three)."""
    def longer(index: pa.Table, chosen: pa.Table) -> pa.Table:
        if not index.num_rows or not chosen.num_rows:
            return _LONGER.empty_table()
        fm = Index(_unpacked(index["sizes"][0].as_py()), _unpacked(index["forward"][0].as_py()), _unpacked(index["backward"][0].as_py()))
        blocks = dict(zip(chosen["bucket"].to_pylist(), chosen["block"].to_pylist()))
        (number,) = _columns(next(b for k, b in blocks.items() if k < 0), 1)
        pairs = _Pairs(fm, number, buckets)
        kept = np.zeros(len(pairs.first), bool)
        for bucket, mask in blocks.items():
            if bucket >= 0:
                begin, end = pairs.begins[bucket], pairs.begins[bucket + 1]
                kept[begin:end] = np.unpackbits(np.frombuffer(mask, np.uint8), count=end - begin)
        b, c, two = pairs.first[kept], pairs.last[kept], pairs.phrases[kept]
        if not len(b):
            return _LONGER.empty_table()
        known = np.sort(b << 32 | c)

        def frequent(first: np.ndarray, second: np.ndarray) -> np.ndarray:
            pair = first << 32 | second
            return known[np.minimum(np.searchsorted(known, pair), len(known) - 1)] == pair

        three = fm.left(two)
        three = three[frequent(three.word, b[three.of])]
        a, b, c = three.word, b[three.of], c[three.of]
        four = fm.right(three.phrases)
        four = four[frequent(c[four.of], four.word)]
        of = four.of
        return pa.concat_tables([
            pa.table([number[a], number[b], number[c], pa.nulls(len(a), pa.int64()), three.phrases.count], schema=_LONGER),
            pa.table([number[a[of]], number[b[of]], number[c[of]], number[four.word], four.phrases.count], schema=_LONGER)])

    return longer


@dataclass(frozen=True)
class Counts:
    """Exact counts over all shards. Words are given by their numbers.

    `words` (word, lang, text, f) and `phrases` (phrase: array of 2 to 4 numbers, f) are those with at least `least`
    occurrences; `sizes` (lang, n) counts all words.
    """

    words: DataFrame
    phrases: DataFrame
    sizes: DataFrame


def count_phrases(docs: DataFrame, least: int = LEAST) -> Counts:
    """Counts of the words and of phrases of two to four words within pieces of `docs`, by language."""
    index = shards(docs)
    entry = F.posexplode(F.arrays_zip("langs", "words", F.slice("counts", F.lit(2), F.size("words")).alias("counts")))
    words = index.select("shard", entry.alias("local", "entry")).select(
        "shard", (F.col("local") + 1).cast("long").alias("local"), F.col("entry.langs").alias("lang"),
        F.col("entry.words").alias("text"), F.col("entry.counts").alias("n"))
    own = F.shiftleft("shard", _WORD_BITS).bitwiseOR(F.col("local"))
    everywhere = Window.partitionBy("text", "lang")  # one row a shard at most
    here = words.withColumn("word", F.min(own).over(everywhere)).withColumn("total", F.sum("n").over(everywhere)).where(F.col("total") >= least)
    known = F.col("word") == own
    here = stored(here.select("shard", "local", "word", *[F.when(known, F.col(c)).alias(c) for c in ("lang", "text", "total")]), "words")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))

    size = here.agg(F.sum("total")).first()[0] or 0  # all that buckets have to hold
    buckets = max(1, -(-size // BUCKET_WORDS))
    pairs = stored(
        index.select("shard", "sizes", "forward").groupBy("shard")
        .cogroup(here.select("shard", "local", "word").groupBy("shard"))
        .applyInArrow(_blocks_of_shard(buckets), "bucket long, shard long, block binary")
        .groupBy("bucket").applyInArrow(_summed_bucket(least), "bucket long, shard long, block binary, w1 long, w2 long, f long"), "pairs")
    longer = (
        index.select("shard", "sizes", "forward", "backward").groupBy("shard")
        .cogroup(pairs.where("block IS NOT NULL").select("shard", "bucket", "block").groupBy("shard"))
        .applyInArrow(_longer_of_shard(buckets), "w1 long, w2 long, w3 long, w4 long, n long")
        .groupBy("w1", "w2", "w3", "w4").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    )
    two = pairs.where("block IS NULL").select(F.array("w1", "w2").alias("phrase"), "f")
    more = longer.select(F.array_compact(F.array("w1", "w2", "w3", "w4")).alias("phrase"), "f")
    return Counts(
        here.where("text IS NOT NULL").select("word", "lang", "text", F.col("total").alias("f")),
        stored(two.unionByName(more), "phrases"), sizes)


def with_extensions(phrases: DataFrame) -> DataFrame:
    """Phrases with `left` and `right`: occurrences of the most frequent one with a word more before or behind it."""
    size = F.size("phrase")
    long = phrases.where(size > 2)
    inner = F.explode(F.array(
        F.struct(F.slice("phrase", F.lit(2), size - 1).alias("phrase"), F.col("f").alias("left"), F.lit(None).cast("long").alias("right")),
        F.struct(F.slice("phrase", F.lit(1), size - 1).alias("phrase"), F.lit(None).cast("long").alias("left"), F.col("f").alias("right"))))
    best = long.select(inner.alias("x")).select("x.*").groupBy("phrase").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    return phrases.join(best, "phrase", "left")


def score(a: Column, parts: Column) -> Column:
    """floor(2000000 * a / parts), in decimals of 38 digits, since the product may pass 64 bits."""
    return F.call_function("div", a.cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(7,0)"), parts.cast("decimal(21,0)")).cast("long")


def collocations(docs: DataFrame, least: int = LEAST, best: int = BEST) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    `a` counts the phrase, `l` and `r` the two parts of its lowest-scoring cut (the first of equal ones). A phrase of
    which a longer candidate has 80 % of the occurrences is left out; it is enough to look at candidates longer by one
    word, which are at least as frequent as those they are part of. A null language is `und`, a null text empty.
    Repeated rows count each time. Extra columns play no part. An empty table gives no row.
    """
    counts = count_phrases(docs, least)
    phrases = with_extensions(counts.phrases)
    kept = phrases.where(F.coalesce(F.greatest("left", "right"), F.lit(0)) * 100 < F.col("f") * CONTAINED).select("phrase", F.col("f").alias("a"))
    cut = F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("cut")
    cuts = kept.select("phrase", "a", cut).select(
        "phrase", "a", "cut", F.slice("phrase", F.lit(1), F.col("cut")).alias("first"),
        F.slice("phrase", F.col("cut") + 1, F.size("phrase")).alias("rest"))
    parts = counts.words.select(F.array("word").alias("part"), "f", "lang").unionByName(
        counts.phrases.where(F.size("phrase") < 4).select(F.col("phrase").alias("part"), "f", F.lit(None).cast("string").alias("lang")))
    # The language comes with the first word, that is with the first cut.
    scored = (
        cuts.join(parts.select(F.col("part").alias("first"), F.col("f").alias("l"), "lang"), "first")
        .join(parts.select(F.col("part").alias("rest"), F.col("f").alias("r")), "rest")
        .groupBy("phrase", "a").agg(
            F.min(F.struct(score(F.col("a"), F.col("l") + F.col("r")).alias("score"), "cut", "l", "r")).alias("worst"), F.max("lang").alias("lang"))
        .select("lang", "phrase", "a", "worst.l", "worst.r", "worst.score")
    )
    # Ties go on to where the words are known; a task passes on its own best rows only.
    order = [F.desc("score"), F.desc("a")]
    near = scored.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= best)
    near = stored(near.drop("place"), "best")
    spelled = (
        near.select("phrase", F.posexplode("phrase").alias("at", "word")).join(counts.words.select("word", "text"), "word")
        .groupBy("phrase").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda w: w["text"]), " ").alias("spelled"))
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "spelled"))
    ranked = near.join(spelled, "phrase").withColumn("rank", rank.cast("long")).where(F.col("rank") <= best)
    return ranked.join(counts.sizes, "lang").select("lang", "rank", F.col("spelled").alias("phrase"), "a", "l", "r", "n", "score")
