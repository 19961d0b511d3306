"""Packing documents into token sequences: linear grouping of large pieces, then best fit of small ones.

The plan depends only on how many pieces there are of each length, a table with one row per length up to the
capacity. So the driver plans with at most `capacity` numbers, however large the corpus is, and tasks look
their pieces' places up by length and rank.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

CAPACITY = 4096
END_ID = 1
#: Groups of equal size that large pieces are rounded up in.
GROUPS = 64
#: A piece is large above this share of the capacity.
LARGE = 1 / 8
#: Words whose ids a task remembers; beyond it, the memory starts anew.
REMEMBERED = 1_000_000
#: Parts that the pieces of one length are ranked in, so that a length which most pieces have is no single task.
RANK_PARTS = 1024

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACES = f"{PIECES}, sequence_id long, offset long"


# --- tokens -----------------------------------------------------------------


class _Ids(dict):
    """Ids of a run of characters without blanks, as bytes; learnt on first use.

    The tokenizer splits at white space before all else and joins nothing across it, so a text's ids are
    those of its runs one after the other. Within a run, a final full stop or comma after a letter stands alone,
    if what is left is a letter still when the tokenizer has normalised it (some letters end in a mark then).
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.signs = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}

    def __missing__(self, run: str) -> bytes:
        if run[-1:] in (".", ",") and run[-2:-1].isalpha() and (run.isascii() or self._ends_in_letter(run[:-1])):
            return self[run[:-1]] + self[run[-1]]
        ids = None
        if run.isalpha() and max(run) < "ɐ":  # Latin letters, whose lower case is a letter again
            lower = unicodedata.normalize("NFC", run).lower()
            if lower != run:
                return self[lower] if lower.isalpha() else self._asked(run)
            ids = [t.id for t in self.model.tokenize(lower.encode().decode("latin-1").translate(self.signs))]
        found = self._asked(run) if ids is None else array("I", ids).tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        self[run] = found
        return found

    @staticmethod
    def _ends_in_letter(run: str) -> bool:
        return unicodedata.normalize("NFC", unicodedata.normalize("NFC", run).lower())[-1:].isalpha()

    def _asked(self, run: str) -> bytes:
        return array("I", self.tokenizer.encode(run, add_special_tokens=False).ids).tobytes()

    def of(self, text: str) -> bytes:
        if text.isascii():
            text = text.lower() if "<|" not in text else text
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenized_pieces(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    tokenizer_path: str | None = None,
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """Rows of `PIECES` (and `ids`, unsigned 32-bit little-endian, on request): each document's ids and the end id.

    A document longer than `capacity` is cut, its last piece may be shorter. Null or empty text: the end id alone.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Ids(tokenizer_path or default_tokenizer())
        end, step = array("I", [END_ID]).tobytes(), capacity * 4
        for batch in batches:
            rows, which = [], []
            for row, text in enumerate(batch.column(1)):
                ids = known.of(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((k, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else b""))
                    which.append(row)
            number, start, length, crc, own = zip(*rows, strict=True) if rows else ((),) * 5
            columns = [batch.column(0).take(pa.array(which, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(own, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = PIECES + (", ids binary" if with_ids else "")
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(pieces, schema)


# --- plan -------------------------------------------------------------------


@dataclass
class _Run:
    """`count` sequences alike: pieces of (length, how many), and the room that is left."""

    count: int
    room: int
    parts: list[tuple[int, int]] = field(default_factory=list)


def _grouped(hist: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Lengths, largest first, cut into groups with the same number of pieces: lists of [length, count]."""
    total = sum(hist.values())
    share = max(1, -(-total // groups))
    out: list[list[list[int]]] = []
    room = 0
    for length in sorted(hist, reverse=True):
        left = hist[length]
        while left:
            if not room:
                out.append([])
                room = share
            take = min(left, room)
            out[-1].append([length, take])
            left -= take
            room -= take
    return out


def _configuration(sizes: list[int], counts: list[int], capacity: int) -> dict[int, int]:
    """The largest size left and the fullest addition of others to it: index -> how many."""
    first = next(k for k, c in enumerate(counts) if c)
    room = capacity - sizes[first]
    origin = np.full(room + 1, -1, np.int64)  # size index that reached a sum last; -2 for the start
    origin[0] = -2
    for k in range(first, len(sizes)):
        left = counts[k] - (k == first)
        for _ in range(min(left, room // sizes[k])):
            new = np.zeros(room + 1, bool)
            new[sizes[k] :] = (origin[: room + 1 - sizes[k]] != -1) & (origin[sizes[k] :] == -1)
            if not new.any():
                break
            origin[new] = k
    used = {first: 1}
    at = int(np.flatnonzero(origin != -1)[-1])
    while at:
        k = int(origin[at])
        used[k] = used.get(k, 0) + 1
        at -= sizes[k]
    return used


def _large_runs(hist: dict[int, int], capacity: int, groups: int) -> list[_Run]:
    """Rounded sizes set the configurations; then real lengths take the rounded ones' places."""
    queues = _grouped(hist, groups)
    sizes, counts = [q[0][0] for q in queues], [sum(c for _, c in q) for q in queues]
    heads = [0] * len(queues)
    runs: list[_Run] = []
    while any(counts):
        used = _configuration(sizes, counts, capacity)
        times = min(counts[k] // n for k, n in used.items())
        slots = []
        for k, n in used.items():
            counts[k] -= n * times
            for _ in range(n):
                slot, left = [], times
                while left:
                    entry = queues[k][heads[k]]
                    take = min(left, entry[1])
                    slot.append((entry[0], take))
                    entry[1] -= take
                    left -= take
                    heads[k] += not entry[1]
                slots.append(slot)
        at = [[0, s[0][1]] for s in slots]  # in each slot: which stretch, how much of it is left
        left = times
        while left:
            take = min(a[1] for a in at)
            lengths = [s[a[0]][0] for s, a in zip(slots, at, strict=True)]
            runs.append(_Run(take, capacity - sum(lengths), [(x, 1) for x in lengths]))
            left -= take
            for s, a in zip(slots, at, strict=True):
                a[1] -= take
                if not a[1] and left:
                    a[0] += 1
                    a[1] = s[a[0]][1]
    return runs


def _fit_small(runs: list[_Run], hist: dict[int, int], capacity: int) -> list[_Run]:
    """Best fit, largest first: each length goes where the least room that holds it is left."""
    by_room: dict[int, list[_Run]] = {}
    rooms: list[int] = []

    def put(run: _Run) -> None:
        if run.room not in by_room:
            by_room[run.room] = []
            insort(rooms, run.room)
        by_room[run.room].append(run)

    for run in runs:
        put(run)
    for length in sorted(hist, reverse=True):
        left = hist[length]
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                each = capacity // length
                run = _Run(max(1, left // each), capacity)
            else:
                run = by_room[rooms[k]].pop()
                if not by_room[rooms[k]]:
                    del by_room[rooms.pop(k)]
            each = min(run.room // length, left)
            times = min(run.count, left // each)
            if times < run.count:
                put(_Run(run.count - times, run.room, list(run.parts)))
            put(_Run(times, run.room - each * length, [*run.parts, (length, each)]))
            left -= times * each
    return [run for at in by_room.values() for run in at]


def plan(hist: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE) -> np.ndarray:
    """Places by length and rank: rows of (length, first rank, first sequence, pieces a sequence, first offset).

    Sorted by length and first rank. Pieces of `capacity` are sequences of their own; those above `large`
    times it are grouped, the rest fitted in.
    """
    bound = int(capacity * large)
    runs = [_Run(hist[capacity], 0, [(capacity, 1)])] if hist.get(capacity) else []
    runs += _large_runs({x: n for x, n in hist.items() if bound < x < capacity and n}, capacity, groups)
    runs = _fit_small(runs, {x: n for x, n in hist.items() if x <= bound and n}, capacity)
    ranks: dict[int, int] = {}
    rows, sequence = [], 0
    for run in runs:
        offset = 0
        for length, each in run.parts:
            rows.append((length, ranks.get(length, 0), sequence, each, offset))
            ranks[length] = ranks.get(length, 0) + run.count * each
            offset += length * each
        sequence += run.count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


# --- pieces to places -------------------------------------------------------


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE) -> DataFrame:
    """`pieces` (as `tokenized_pieces` makes them, other columns go along) with `sequence_id` and `offset`.

    Ranks within a length are counted in `RANK_PARTS` parts, whose sizes are then added up. Equal rows get
    different places. No rows in, no rows out.
    """
    pieces = cut(pieces)
    hist = {row["length"]: row["count"] for row in pieces.groupBy("length").count().collect()}  # <= capacity rows
    table = plan(hist, capacity, groups, large)
    columns = pieces.columns
    parted = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_PARTS)))
    before = W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = parted.groupBy("length", "_part").count()
    starts = sizes.select("length", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy("length", "_part").orderBy("doc_id", "piece")) - 1
    ranked = parted.withColumn("_inside", inside).join(starts, ["length", "_part"])
    ranked = ranked.select(*columns, (F.col("_start") + F.col("_inside")).alias("_rank"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (table[:, 0].astype(np.uint64) << np.uint64(48)) + table[:, 1].astype(np.uint64)
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, (length.astype(np.uint64) << np.uint64(48)) + rank.astype(np.uint64), "right") - 1
            row = table[at]
            order = rank - row[:, 1]
            sequence, slot = row[:, 2] + order // row[:, 3], order % row[:, 3]
            kept = [batch.column(name) for name in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence, pa.int64()), pa.array(row[:, 4] + slot * length, pa.int64())], [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{name}` {kind}" for name, kind in pieces.dtypes)
    return ranked.mapInArrow(placed, f"{schema}, sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """Finished sequences: `sequence_id`, `length`, `ids`; `placed` must carry `ids`. A group holds `capacity` ids at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.transform(parts, lambda p: p["ids"]), F.lit(b""), lambda a, b: F.concat(a, b))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))


def pack_documents(docs: DataFrame, **options: object) -> DataFrame:
    """Rows of `PLACES`, one per piece of `docs`."""
    capacity = int(options.get("capacity", CAPACITY))
    return pack(tokenized_pieces(docs, **options), capacity=capacity)
