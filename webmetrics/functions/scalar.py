"""Column helpers. All are built-in Spark expressions, so they stay inside generated code."""

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_day(c: ColumnLike) -> Column:
    """'20210131' -> date."""
    return F.to_date(col(c), "yyyyMMdd")


def from_micros(c: ColumnLike) -> Column:
    return F.timestamp_micros(col(c))


def day_of(ts: ColumnLike) -> Column:
    """Calendar day in the session time zone, which the library expects to be UTC."""
    return F.to_date(col(ts))


def days_between(later: ColumnLike, earlier: ColumnLike) -> Column:
    """Signed whole days; NULL if either side is."""
    return F.datediff(col(later), col(earlier))


def shift_days(day: ColumnLike, days: int | Column) -> Column:
    return F.date_add(col(day), days)


def iso_text(day: ColumnLike) -> Column:
    return col(day).cast("string")


def time_text(ts: ColumnLike) -> Column:
    return F.date_format(col(ts), "HH:mm:ss")


def blank_to_null(c: ColumnLike) -> Column:
    return F.nullif(col(c), F.lit(""))


def or_else(c: ColumnLike, placeholder: str | Column) -> Column:
    """Replace NULL only."""
    other = placeholder if isinstance(placeholder, Column) else F.lit(placeholder)
    return F.coalesce(col(c), other)


def named(c: ColumnLike, placeholder: str | Column) -> Column:
    """Replace NULL and the empty text."""
    return or_else(blank_to_null(c), placeholder)


def flag(condition: Column) -> Column:
    """1 where the condition holds; 0 where it fails or is NULL."""
    return F.when(condition, 1).otherwise(0)


def flag_not_null(c: ColumnLike) -> Column:
    return col(c).isNotNull()


def line_total(price: ColumnLike, quantity: ColumnLike) -> Column:
    return col(price) * col(quantity)


def money(c: ColumnLike) -> Column:
    """Two decimals, halves away from zero."""
    return F.round(col(c), 2)


def ratio(part: ColumnLike, whole: ColumnLike) -> Column:
    """Double division; NULL when the whole is 0 or NULL, never an ANSI error."""
    return F.try_divide(col(part).cast("double"), col(whole).cast("double"))


def percent(part: ColumnLike, whole: ColumnLike) -> Column:
    return ratio(part, whole) * F.lit(100.0)


def percent_or_zero(part: ColumnLike, whole: ColumnLike) -> Column:
    return F.coalesce(percent(part, whole), F.lit(0.0))


def medium_label(c: ColumnLike, direct: str) -> Column:
    """Option label: NULL, empty and white-space-only mediums read as direct traffic."""
    return F.when(col(c).rlike(r"\S"), col(c)).otherwise(F.lit(direct))
