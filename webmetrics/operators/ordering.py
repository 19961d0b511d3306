"""Sorting, top-k and pages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from webmetrics.spec import SortKey

PAGE_SIZE = 20


def directed(column: Column, ascending: bool) -> Column:
    """NULLs last either way."""
    return column.asc_nulls_last() if ascending else column.desc_nulls_last()


def order_by(keys: Sequence[SortKey], shown: dict[str, Column],
             default: Sequence[tuple[Column, bool]]) -> list[tuple[Column, bool]]:
    """(column, ascending) keys on what the reader sees; the default if none is valid."""
    return [(shown[key.column], key.ascending) for key in keys] or list(default)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Planned as TakeOrderedAndProject: k rows per task, no full sort."""
    return df.orderBy(*order).limit(k)


def page(df: DataFrame, order: Sequence[Column], number: int | None,
         size: int = PAGE_SIZE) -> DataFrame:
    """Rows of one page, counted from 0. Past the end: no rows.

    Each task keeps the rows up to the end of the page, so follow ``page_after`` to go deep.
    """
    return df.orderBy(*order).offset((number or 0) * size).limit(size)


def at_most(df: DataFrame, key: Column, ascending: bool, edge: Column) -> DataFrame:
    """Rows not behind ``edge`` in the order of ``key``; NULLs stay, as they sort last."""
    return df.where((key <= edge if ascending else key >= edge) | key.isNull())


def reaching(df: DataFrame, key: Column, ascending: bool, rows: int) -> DataFrame:
    """Rows that can be among the first ``rows`` in an order that starts with ``key``.

    A first pass over the key alone finds its value in the last of these rows. Where ``key`` is
    a stored column, the wide second pass then skips all row groups behind that value.
    """
    keys = df.select(key.alias("key")).where("key IS NOT NULL")
    edge = F.max("key") if ascending else F.min("key")
    first = top_k(keys, [directed(F.col("key"), ascending)], rows).agg(edge)
    return at_most(df, key, ascending, first.scalar())


def page_count(total: Column, size: int = PAGE_SIZE) -> Column:
    """Pages needed for ``total`` rows, at least one."""
    return F.greatest(F.lit(1), F.ceil(total / F.lit(float(size)))).cast("int")


def not_before(keys: Sequence[tuple[Column, bool]], last: Sequence) -> Column:
    """Rows that an order by (column, ascending) keys, NULLs last, does not put before ``last``."""
    result = F.lit(True)
    for (column, ascending), value in reversed(list(zip(keys, last, strict=True))):
        if value is None:
            result = column.isNull() & result
            continue
        beyond = column > F.lit(value) if ascending else column < F.lit(value)
        result = beyond | column.isNull() | ((column == F.lit(value)) & result)
    return result


@dataclass(frozen=True)
class Cursor:
    """Where a page ended: the sort values of its last row, and how many rows with exactly
    these values were shown so far (rows that agree in all of them are interchangeable)."""

    values: tuple
    shown: int

    @staticmethod
    def after(rows: Sequence[Sequence], before: Cursor | None = None) -> Cursor | None:
        """The cursor behind a page, given the sort values of its rows and the page's own
        cursor; None behind an empty page."""
        if not rows:
            return None
        last = tuple(rows[-1])
        shown = sum(tuple(r) == last for r in rows)
        if before is not None and before.values == last:
            shown += before.shown
        return Cursor(last, shown)


def portable_keys(df: DataFrame, keys: Sequence[tuple[Column, bool]], cursor: Cursor | None) -> tuple[Column, Cursor | None]:
    """A ``sort_values`` struct of the keys, and ``cursor`` with its values as the keys' own types.

    Times travel as microseconds: Python's own would pass through the driver's zone.
    """
    fields = df.select(*[c.alias(f"key_{i}") for i, (c, _) in enumerate(keys)]).schema
    times = [isinstance(f.dataType, TimestampType) for f in fields]
    if cursor is not None:
        cursor = Cursor(tuple(
            F.timestamp_micros(F.lit(v)) if time and v is not None else v
            for v, time in zip(cursor.values, times, strict=True)), cursor.shown)
    values = F.struct(*[
        (F.unix_micros(c) if time else c).alias(f"key_{i}")
        for i, ((c, _), time) in enumerate(zip(keys, times, strict=True))])
    return values.alias("sort_values"), cursor


def behind(df: DataFrame, keys: Sequence[tuple[Column, bool]],
           cursor: Cursor | None) -> DataFrame:
    """Rows from the cursor's values on, those shown already included."""
    return df if cursor is None else df.where(not_before(keys, cursor.values))


def page_after(df: DataFrame, keys: Sequence[tuple[Column, bool]], cursor: Cursor | None,
               size: int = PAGE_SIZE) -> DataFrame:
    """The next page. Work does not grow with the number of pages before it."""
    order = [directed(c, ascending) for c, ascending in keys]
    shown = cursor.shown if cursor else 0
    return behind(df, keys, cursor).orderBy(*order).offset(shown).limit(size)
