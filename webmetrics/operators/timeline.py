"""Rows stored in order of time, so that the latest ones are found without opening the rest.

A timeline is cut into stretches, each a partition of its own. Stretches follow one another in time
and are described by an index: first and last moment, first and last day, rows. Whoever asks for the
latest matching rows looks at the latest stretches, then at twice as many, until there are enough;
how much is read depends on the rows asked for and on how rare matches are, not on the table's size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webmetrics.functions.predicates import f_date
from webmetrics.spec import Day

MOMENT, DAY, STRETCH = "event_datetime", "event_date", "stretch"
#: Rows of a stretch, about.
ROWS_PER_STRETCH = 1_000_000
#: Ranges that are sorted apart, unless there are fewer stretches.
LEAST_RANGES = 200
#: Stretches looked at first.
FIRST_LOOK = 2

#: Gets the rows of some stretches and the moment (microseconds) from which on they are complete, and
#: returns those that count.
Match = Callable[[DataFrame, int], DataFrame]


def cut_into_stretches(rows: DataFrame, total: int, size: int, order: Sequence[str] = ()) -> DataFrame:
    """``rows``, ``total`` of them, with their stretch of about ``size`` rows, from the earliest to the latest; rows
    without a time come first.

    ``order`` names further columns, which spread rows of one moment over several stretches. The driver samples keys
    for each range, so there are no more ranges than tasks are wanted; each is sorted and cut into its stretches where
    it lies.
    """
    count = max(1, -(-total // size))
    ranges = min(count, max(LEAST_RANGES, -(-total // ROWS_PER_STRETCH)))
    within = -(-count // ranges)
    keys = [F.asc_nulls_first(c) for c in (MOMENT, *order)]
    dealt = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    if within == 1:
        return dealt.withColumn(STRETCH, F.spark_partition_id())
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # of a row in its range
    number = F.least(F.floor(place / F.lit(-(-total // (ranges * within)))), F.lit(within - 1))
    return dealt.withColumn(STRETCH, (F.spark_partition_id() * within + number).cast("int"))


def describe(rows: DataFrame) -> DataFrame:
    """The index of stored stretches; only times and days are read. Times are microseconds, so that
    no driver's zone plays a part. Where some rows have no time or day, the first one is NULL."""
    def first(c: Column) -> Column:
        return F.when(F.count(c) == F.count(F.lit(1)), F.min(c))

    moment, day = F.unix_micros(MOMENT), F.col(DAY)
    return rows.groupBy(STRETCH).agg(
        first(moment).alias("first"), F.max(moment).alias("last"),
        first(day).alias("first_day"), F.max(day).alias("last_day"), F.count(F.lit(1)).alias("rows"))


@dataclass(frozen=True)
class Timeline:
    """Stored rows with their stretch, and the index."""

    rows: DataFrame
    index: DataFrame

    def _from(self, low: int, moment: Column | None) -> DataFrame:
        rows = self.rows.where(F.col(STRETCH) >= low)
        return rows if moment is None else rows.where(F.col(MOMENT) >= moment)

    def since(self, micros: int) -> DataFrame:
        """All rows from a moment on."""
        low = self.index.where(F.col("last") >= micros).agg(F.min(STRETCH)).first()[0]
        return self.rows.where("false") if low is None else self._from(low, F.timestamp_micros(F.lit(micros)))

    def latest(self, count: int, match: Match, start: Day = None, end: Day = None,
               until: int | None = None) -> tuple[DataFrame, int | None]:
        """Rows that have the ``count`` latest matching ones, and the moment (microseconds) from which
        on all are there; None if that is from the beginning.

        ``start`` and ``end`` tell that only rows of these days match, ``until`` that only rows up to
        that moment do: later stretches, and those of other days, are not looked at.
        """
        asked = self.index
        if until is not None:
            asked = asked.where(F.col("first").isNull() | (F.col("first") <= until))
        if start is not None:
            asked = asked.where(f_date("last_day", start))
        if end is not None:
            asked = asked.where(F.col("first_day").isNull() | f_date("first_day", None, end))
        look = FIRST_LOOK
        while True:
            entries = asked.orderBy(F.desc(STRETCH)).limit(look + 1).collect()  # no more than is looked at
            if not entries:
                return self.rows.where("false"), None
            newest = F.col(STRETCH) <= entries[0][STRETCH]
            edge = entries[look - 1]["first"] if len(entries) > look else None
            if edge is None:
                return self._from(entries[-1][STRETCH] if len(entries) <= look else 0, None).where(newest), None
            # Rows of the earliest moment may go on in stretches before.
            rows = self.since(edge).where(newest)
            if match(rows, edge).limit(count).count() >= count:
                return rows, edge
            look *= 2
