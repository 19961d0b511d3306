"""N-gram Jaccard join by vertical partitioning.

N-grams have one global order, rare before common. The order is cut into fragments; candidate pairs come from
the rare beginnings of the ordered sets, and a pair's overlap is counted in each fragment apart and summed.
Documents with one and the same set are one node, and a group of near copies is linked through few of its
members, so that no group is written out as all its pairs; its links are counted by blocks of sets.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, filter_bit, member_bits
from .components import components
from .textcore import Texts, mix, runs_of, slices, words

#: Counters of the order: n-grams are counted by hash in so many, whatever the corpus holds.
COUNTERS = 1 << 20
_BLOCK = 4096  # counters of a row that tasks hand over
#: Levels of frequency in the order: so many to each doubling.
_LEVELS_PER_DOUBLING = 4
FRAGMENTS = 8
#: Longs of a set's parity sketch: bit k is whether an odd number of its n-grams falls to k.
SKETCH = 8
#: Sets of `LARGE` n-grams and more have a wider sketch besides, of so many longs.
WIDE, LARGE = 64, 800
#: N-grams of a block of sets whose links are counted together; a set counts as `LEAST_WEIGHT` of them at least.
BLOCK, LEAST_WEIGHT = 1 << 17, 128
#: N-grams of so many sets of a block give their pairs one by one.
FEW = 8
#: Place of documents without an id.
NO_ID = -(1 << 63)


def _sets(texts: Texts, size: int) -> list[np.ndarray]:
    """Distinct n-gram hashes of each text, sorted; a text with fewer words is one n-gram."""
    found = words(texts)
    first = found.first
    whole = runs_of(found, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        elif b > a:
            value = np.array([b - a], np.uint64)
            for k in range(a, b):
                value = mix(value * np.uint64(0x9E3779B97F4A7C15) + found.hash[k : k + 1])
            out.append(value)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _set_key(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))


def _measured(docs: DataFrame, size: int) -> DataFrame:
    """A row for each document (doc_id, n, set_key), and rows of counters (block, counters) for each task."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS, np.int32)
        none = pa.nulls
        for batch in batches:
            n, keys = [], []
            for texts in slices(batch.column(1)):
                sets = _sets(texts, size)
                every = (np.concatenate(sets) & np.uint64(COUNTERS - 1)).astype(np.int64)
                counters += np.bincount(every, minlength=COUNTERS).astype(np.int32)
                for own in sets:
                    n.append(len(own))
                    keys.append(_set_key(own))
            rows = len(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), none(rows, pa.int32()), none(rows, pa.binary())], ["doc_id", "n", "set_key", "block", "counters"])
        blocks = counters.reshape(-1, _BLOCK)
        full = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays([none(len(full), pa.int64()), none(len(full), pa.int64()), none(len(full), pa.binary()), pa.array(full, pa.int32()), pa.array([zlib.compress(blocks[k].tobytes(), 1) for k in full], pa.binary())], ["doc_id", "n", "set_key", "block", "counters"])

    return docs.mapInArrow(measure, "doc_id long, n long, set_key binary, block int, counters binary")


def _levels(measured: DataFrame) -> np.ndarray:
    """Frequency level of each counter, from the counts of all tasks; blocks are summed as streams of rows."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[block] = total.get(block, 0) + np.frombuffer(zlib.decompress(raw), np.int32).astype(np.int64)
        level = {k: np.minimum(np.log2(v + 1) * _LEVELS_PER_DOUBLING, 127).astype(np.uint8).tobytes() for k, v in total.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(level), pa.int32()), pa.array(list(level.values()), pa.binary())], ["block", "level"])

    blocks = measured.where("block is not null").select("block", "counters").repartition(64, "block")
    out = np.zeros(COUNTERS, np.uint8)
    for row in blocks.mapInArrow(summed, "block int, level binary").collect():  # COUNTERS bytes in all
        out[row["block"] * _BLOCK : (row["block"] + 1) * _BLOCK] = np.frombuffer(row["level"], np.uint8)
    return out


def _ordered(own: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The set as keys in the global order: level, then hash."""
    level = levels[(own & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64)
    return np.sort((level << np.uint64(56)) | (own >> np.uint64(8))).astype(np.int64)


def _pivots(measured_levels: np.ndarray, fragments: int) -> np.ndarray:
    """Cuts of the global order into stretches of about equal numbers of n-gram occurrences."""
    weight = np.bincount(measured_levels, 2.0 ** (measured_levels / _LEVELS_PER_DOUBLING) - 1, minlength=128)
    total = np.cumsum(weight)
    cuts = []
    for k in range(1, fragments):
        goal = total[-1] * k / fragments
        level = int(np.searchsorted(total, goal))
        inside = (goal - (total[level - 1] if level else 0)) / max(weight[min(level, 127)], 1e-9)
        cuts.append((min(level, 127) << 56) + int(min(max(inside, 0.0), 0.999999) * (1 << 56)))
    return np.array(sorted(cuts), np.int64)


def _sketch(own: np.ndarray, longs: int = SKETCH) -> np.ndarray:
    """Sets that differ in d n-grams differ in at most d bits of it."""
    odd = np.bincount(((own >> np.uint64(8)) & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _close(percent: int) -> Column:
    """Whether the sketches of `x` and `y` allow sets that are alike enough."""
    bits = sum((F.bit_count(F.col(f"x.s{k}").bitwiseXOR(F.col(f"y.s{k}"))) for k in range(SKETCH)), F.lit(0))
    return bits * (100 + percent) <= (100 - percent) * (F.col("x.n") + F.col("y.n"))


def _close_wide(percent: int) -> Column:
    """The same for the wider sketches, if both have one."""
    apart = F.zip_with("x.wide", "y.wide", lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    bits = F.aggregate(apart, F.lit(0), lambda a, b: a + b)
    both = F.col("x.wide").isNotNull() & F.col("y.wide").isNotNull()
    return F.when(both, bits * (100 + percent) <= (100 - percent) * (F.col("x.n") + F.col("y.n"))).otherwise(True)


def _beginnings(docs: DataFrame, size: int, levels, percent: int) -> DataFrame:
    """(doc_id, set_key, n, keys, sketch): the rarest n-grams, of which any set that is alike enough shares one."""

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(levels.value, np.uint8)
        for batch in batches:
            n, keys, names, sketches, wide = [], [], [], [], []
            for texts in slices(batch.column(1)):
                for own in _sets(texts, size):
                    n.append(len(own))
                    names.append(_set_key(own))
                    sketches.append(_sketch(own))
                    wide.append(_sketch(own, WIDE) if len(own) >= LARGE else None)
                    length = len(own) - (percent * len(own) + 99) // 100 + 1 if len(own) else 0
                    keys.append(_ordered(own, table)[:length])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.binary()), pa.array(n, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (keys, sketches, wide))], ["doc_id", "set_key", "n", "keys", "sketch", "wide"])

    return docs.mapInArrow(begin, "doc_id long, set_key binary, n long, keys array<long>, sketch array<long>, wide array<long>")


def _fragments(docs: DataFrame, size: int, levels, pivots: np.ndarray, bits: bytes) -> DataFrame:
    """(doc_id, set_key, fragment, keys) of documents that the membership filter lets pass."""

    def fragment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, passing = np.frombuffer(levels.value, np.uint8), np.frombuffer(bits, np.uint8)
        for batch in batches:
            bit = batch.column(2).to_numpy(zero_copy_only=False)
            keep = (passing[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0
            kept = batch.filter(pa.array(keep))
            for texts in slices(kept.column(1)):
                ids, names, which, parts = [], [], [], []
                for k, own in enumerate(_sets(texts, size)):
                    keys, name = _ordered(own, table), _set_key(own)
                    for f, part in enumerate(np.split(keys, np.searchsorted(keys, pivots))):
                        if len(part):
                            ids.append(texts.first + k)
                            names.append(name)
                            which.append(f)
                            parts.append(part)
                yield pa.RecordBatch.from_arrays([kept.column(0).take(pa.array(ids, pa.int64())), pa.array(names, pa.binary()), pa.array(which, pa.int32()), pa.array(parts, pa.list_(pa.int64()))], ["doc_id", "set_key", "fragment", "keys"])

    rows = docs.withColumn("bit", filter_bit(F.xxhash64(_place())))
    return rows.mapInArrow(fragment, "doc_id long, set_key binary, fragment int, keys array<long>")


def _possible(percent: int) -> Column:
    """Length and positional filter of entries `x` and `y` that share an n-gram."""
    shorter, longer = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    before = F.least("x.at", "y.at")
    after = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    enough = (before + after) * (100 + percent) >= percent * (F.col("x.n") + F.col("y.n"))
    return (shorter * 100 >= longer * percent) & enough


def _place() -> Column:
    """Where a document is looked for: its id; those without one share a place."""
    return F.coalesce("doc_id", F.lit(NO_ID)).alias("place")


def _overlaps(keys: np.ndarray, owner: np.ndarray, sets: int) -> np.ndarray:
    """How many keys each two of `sets` sets share; `owner` tells the set of each key. The diagonal is of no use."""
    values, of, times = np.unique(keys, return_inverse=True, return_counts=True)
    order = np.argsort(of, kind="stable")
    who, begin = owner[order], np.cumsum(times) - times
    few = FEW if sets > 4 * FEW else 1
    common = np.zeros((sets, sets), np.float32)
    for size in range(2, few + 1):  # keys of few sets give their pairs
        own = who[begin[times == size][:, None] + np.arange(size)]
        for a in range(size):
            for b in range(a + 1, size):
                common += np.bincount(own[:, a] * sets + own[:, b], minlength=sets * sets).reshape(sets, sets)
    common += common.T
    many = np.flatnonzero(times > few)  # the others are columns of a product
    for first in range(0, len(many), 4096):
        some = many[first : first + 4096]
        held = np.zeros((sets, len(some)), np.float32)
        for column, k in enumerate(some.tolist()):
            held[who[begin[k] : begin[k] + times[k]], column] = 1
        common += held @ held.T
    return common


def _counter(percent: int):
    """Counts, for the sets of one block or of two, how many of the block's (or of the other's) are alike enough."""

    def count(table: pa.Table) -> pa.Table:
        keys = table.column("keys").combine_chunks()
        n = pa.compute.list_value_length(keys).to_numpy(zero_copy_only=False).astype(np.int64)
        common = _overlaps(keys.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n), len(n))
        alike = common * 100 >= percent * (n[:, None] + n[None, :] - common)
        np.fill_diagonal(alike, False)
        block = table.column("block").to_numpy()
        if block.min() != block.max():
            alike &= block[:, None] != block[None, :]
        elif table.column("i")[0] != table.column("j")[0]:
            alike[:] = False  # hashing left the other block empty
        return pa.table({"node": table.column("node"), "n_links": pa.array(alike.sum(1), pa.int64())})

    return count


class _Join:
    def __init__(self, docs: DataFrame, size: int, percent: int, fragments: int) -> None:
        self.docs, self.size, self.percent = docs, size, percent
        measured = cut(_measured(docs, size))
        levels = _levels(measured)
        self.levels = docs.sparkSession.sparkContext.broadcast(levels.tobytes())
        self.pivots = _pivots(levels, fragments)
        self.measured = measured.where("block is null").select("doc_id", "n", "set_key")
        some = self.measured.where("n > 0")
        # Ids that are repeated with other texts.
        own = some.where("doc_id is not null").select("doc_id", "set_key")
        twice = cut(own.distinct().groupBy("doc_id").count().where("count > 1").select("doc_id"))
        self.twice = None if twice.isEmpty() else twice
        # Every distinct set is a node, whatever ids have it. Numbers follow the smallest ids and are kept with the checkpoint.
        sets = some.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"))
        sets = sets.select("set_key", "n", F.col("doc_id").alias("low"), _place())
        sets = sets.repartitionByRange("low").sortWithinPartitions("low")
        self.sets = cut(sets.withColumn("node", F.monotonically_increasing_id()))

    def same_ids(self) -> DataFrame:
        """Links (a, b) between the sets of an id that is repeated with other texts."""
        of_id = self.measured.join(self.twice, "doc_id", "left_semi").join(self.sets.select("set_key", "node"), "set_key")
        of_id = of_id.select("doc_id", "node").distinct()
        least = of_id.groupBy("doc_id").agg(F.min("node").alias("a"))
        return of_id.join(least, "doc_id").where("node != a").select("a", F.col("node").alias("b")).distinct()

    def beginnings(self) -> DataFrame:
        """(doc, n, keys, sketches) of each distinct set, `doc` being its number."""
        begun = _beginnings(self.docs, self.size, self.levels, self.percent)
        return self._of_nodes(begun, []).select(F.col("node").alias("doc"), "n", "keys", "sketch", "wide")

    def _of_nodes(self, rows: DataFrame, key: list[str]) -> DataFrame:
        """Rows of each node's first document, once for each `key`; one shuffle by document and set serves both."""
        nodes = self.sets.select("place", "set_key", "node")
        found = rows.withColumn("place", _place()).drop("doc_id").join(nodes, ["place", "set_key"])
        return found.dropDuplicates(["place", "set_key", *key]).drop("place", "set_key")

    def _parts(self, nodes: DataFrame, pivots: np.ndarray) -> DataFrame:
        """(node, fragment, keys) of at least `nodes` (id)."""
        places = nodes.join(self.sets.select(F.col("node").alias("id"), "place"), "id")
        bits = member_bits(places, F.xxhash64("place"))
        return self._of_nodes(_fragments(self.docs, self.size, self.levels, pivots, bits), ["fragment"])

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Of candidate pairs (a, b), those that are alike enough: overlaps counted by fragment, then summed."""
        parts = cut(self._parts(pairs.select(F.explode(F.array("a", "b")).alias("id")), self.pivots))
        left = parts.select(F.col("node").alias("a"), "fragment", F.col("keys").alias("a_keys"))
        right = parts.select(F.col("node").alias("b"), "fragment", F.col("keys").alias("b_keys"))
        both = pairs.join(left, "a").join(right, ["b", "fragment"])
        partial = both.select("a", "b", F.size(F.array_intersect("a_keys", "b_keys")).cast("long").alias("shared"))
        sums = partial.groupBy("a", "b").agg(F.sum("shared").alias("shared"))
        sums = sums.join(self.sets.select(F.col("node").alias("a"), F.col("n").alias("a_n")), "a")
        sums = sums.join(self.sets.select(F.col("node").alias("b"), F.col("n").alias("b_n")), "b")
        return sums.where(F.col("shared") * 100 >= self.percent * (F.col("a_n") + F.col("b_n") - F.col("shared")))

    def degrees(self, known: DataFrame) -> DataFrame:
        """(node, n_links): of each node of `known` (node, component), how many others are alike enough.

        Those are in its component. A component is dealt into blocks of about `BLOCK` n-grams, and each two blocks
        are compared by one task, which holds no more than these and gives a row for each of their sets.
        """
        placed = known.join(self.sets.select("node", "n"), "node")
        weight = F.sum(F.greatest("n", F.lit(LEAST_WEIGHT)))
        blocks = placed.groupBy("component").agg(F.ceil(weight / F.lit(BLOCK)).cast("int").alias("blocks"))
        block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
        dealt = placed.join(blocks, "component").select("node", "component", "blocks", block)
        whole = self._parts(known.select(F.col("node").alias("id")), np.zeros(0, np.int64)).select("node", "keys")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        sides = whole.join(dealt, "node").select("node", "component", "block", "keys", other)
        sides = sides.select("node", "component", "block", "keys", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        counted = sides.groupBy("component", "i", "j").applyInArrow(_counter(self.percent), "node long, n_links long")
        return counted.groupBy("node").agg(F.sum("n_links").alias("n_links"))


def ngram_components(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    size: int = 3,
    percent: int = 90,
    fragments: int = FRAGMENTS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row of `docs`.

    Words are what ASCII white space parts, A-Z in lower case. A set is the distinct `size`-word n-grams of a whole
    text, with fewer words all of them as one n-gram. Two documents are linked when 100 times what both sets hold is
    at least `percent` times what either holds; `component_id` is the smallest id reachable by links, and `n_links`
    to how many different sets a document's set is linked.

    1. Every text's set gets a 128-bit key; equal sets are one node.
    2. Counts of all n-grams, in counters of a fixed number, order n-grams from rare to common.
    3. First candidates: each n-gram in the beginnings of sets pairs its sets with one of them only.
    4. Overlaps are counted by fragment and summed; links give components.
    5. Then every pair whose sets share such an n-gram, passes the length, positional and sketch filters, and is not
       in one component yet, is counted alike. So no pair that could join two components is missed, and groups of
       near copies never give all their pairs as rows.
    6. All links lie inside components. Blocks of a component's sets are compared two by two, which counts the links.

    Null or empty texts, and texts of white space, have empty sets and are linked with nothing. Rows without an id are
    linked as others are; a component of such rows only has no id. Repeated rows are one document; an id that is
    repeated with other texts links them and what equals them, which `n_links` does not count. Empty tables give no rows.
    """
    rows = _rows(docs, id_column, text_column)
    join = _Join(rows, size, percent, fragments)
    begun = cut(join.beginnings())
    entries = begun.select("doc", "n", F.posexplode("keys").alias("at", "token"))
    # Most rare n-grams are in one set only; only what is left of them is kept.
    leaders = entries.groupBy("token").agg(F.min("doc").alias("leader"), F.count(F.lit(1)).alias("sets"))
    shared = cut(entries.join(leaders.where("sets > 1").drop("sets"), "token"))
    starred = shared.alias("x").join(shared.where("doc = leader").alias("y"), "token").where(F.col("x.doc") != F.col("y.doc"))
    first = starred.where(_possible(percent)).select(F.col("y.doc").alias("a"), F.col("x.doc").alias("b")).distinct()
    sketches = begun.select("doc", "n", "wide", *(F.col("sketch")[k].alias(f"s{k}") for k in range(SKETCH)))

    def near(pairs: DataFrame) -> DataFrame:
        ends = pairs.join(sketches.alias("x"), F.col("a") == F.col("x.doc")).join(sketches.alias("y"), F.col("b") == F.col("y.doc"))
        return ends.where(_close(percent) & _close_wide(percent)).select("a", "b")

    first = cut(near(first))
    links = cut(join.linked(first).select("a", "b"))
    known = components(links)
    # Only n-grams that sets of several components hold can give more.
    placed = shared.join(known.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    mixed = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token")
    placed = cut(placed.join(mixed, "token", "left_semi").join(sketches.drop("n", "wide"), "doc"))
    apart = placed.alias("x").join(placed.alias("y"), "token").where(F.col("x.doc") < F.col("y.doc")).where(F.col("x.component") != F.col("y.component"))
    second = apart.where(_possible(percent) & _close(percent)).select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct()
    second = cut(near(second.join(first, ["a", "b"], "left_anti")))
    links = cut(links.unionByName(join.linked(second).select("a", "b")))
    final = cut(components(links if join.twice is None else links.unionByName(join.same_ids())))
    own = final.join(join.sets.select("node", "low"), "node")
    lows = own.groupBy("component").agg(F.min("low").alias("smallest"))
    placed = final.join(lows, "component").join(join.degrees(final), "node", "left").select("node", "smallest", "n_links")
    nodes = join.sets.select("set_key", "node", "low").join(placed, "node", "left")
    nodes = nodes.select("set_key", F.coalesce("smallest", "low").alias("smallest"), "n_links")
    out = join.measured.join(nodes, "set_key", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("smallest"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
