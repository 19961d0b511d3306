"""Writers. Rows go from tasks to files; only counts come back to the driver."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import functions as F

from webmetrics.functions.scalar import ColumnLike, col
from webmetrics.operators.flatten import prune
from webmetrics.schema import STORED_COLUMNS
from webmetrics.sources.scan import has_table
from webmetrics.sources.versions import Spec, Version, base_folder, write_version
from webmetrics.spec import Day, as_day


def write_parquet(df: DataFrame, path: str, rows_per_group: int | None = None,
                  rows_per_file: int | None = None,
                  partition_by: tuple[str, ...] = (), replace: str = "all",
                  rebalance: bool = False) -> None:
    """Snappy Parquet.

    Row groups are bounded by Parquet's byte size; ``rows_per_group`` (``CHUNK_ROWS`` is the
    published choice) bounds their rows as well, which on a large table makes many small ones.
    ``rows_per_file`` cuts files too where that is wanted.
    ``replace='all'`` overwrites the target; ``'partitions'`` only the partitions present in
    ``df``, e.g. one reloaded month.

    ``rebalance`` shuffles rows by ``partition_by`` before writing. Use it when the rows are
    not yet clustered that way, since each task writes a file per partition it meets. AQE sizes
    the tasks: small partitions share one, a partition with most of the rows gets several.
    """
    if rebalance:
        df = df.hint("rebalance", *partition_by)
    times_with_statistics(df.sparkSession)
    _parquet_writer(df, rows_per_group, rows_per_file, partition_by, replace).parquet(path)


def times_with_statistics(spark: SparkSession) -> None:
    """Let the session store times as 64-bit microseconds: unlike the default type, these have
    minima and maxima per row group, by which a time range skips data.

    Set for good, since switching it back would reach loads that run at the same time.
    """
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")


def _parquet_writer(df: DataFrame, rows_per_group: int | None, rows_per_file: int | None,
                    partition_by: tuple[str, ...], replace: str) -> DataFrameWriter:
    if replace not in ("all", "partitions"):
        raise ValueError("replace must be 'all' or 'partitions'")
    writer = (
        df.write.format("parquet").mode("overwrite")
        .option("compression", "snappy")
        .option("partitionOverwriteMode", "static" if replace == "all" else "dynamic")
    )
    if rows_per_group:
        writer = writer.option("parquet.block.row.count.limit", rows_per_group)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    return writer.partitionBy(*partition_by) if partition_by else writer


def drop_partitions(spark: SparkSession, path: str, column: str, gone: Callable[[str], bool]) -> None:
    """Remove those folders ``column=value`` under ``path`` whose value is ``gone``."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return
    for status in files.listStatus(root):
        name, _, value = status.getPath().getName().partition("=")
        if name == column and gone(value):
            files.delete(status.getPath(), True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_table(df: DataFrame, name: str, location: str | None = None) -> None:
    """Append rows, matching columns by name; the first call creates the table."""
    spark = df.sparkSession
    times_with_statistics(spark)
    if has_table(spark, name):
        df.select(*spark.table(name).columns).write.insertInto(name)
        return
    writer = _parquet_writer(df, None, None, (), "all").mode("errorifexists")
    (writer.option("path", location) if location else writer).saveAsTable(name)


@dataclass(frozen=True)
class RowCount:
    """The number of rows that passed a point of a plan, known after the action."""

    observation: Observation

    @property
    def rows(self) -> int:
        try:
            return self.observation.get["rows"]
        except Py4JJavaError as error:
            # AQE drops what lies before an empty shuffle, the counter included; Spark then has
            # a row without values and asserts. An action that failed has raised before this.
            if error.java_exception.getClass().getName() != "java.lang.AssertionError":
                raise
            return 0


def counted(df: DataFrame) -> tuple[DataFrame, RowCount]:
    """Count rows while an action reads them, without a pass of its own."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), RowCount(seen)


@dataclass(frozen=True)
class DayCount(RowCount):
    """Rows and the day shards (``YYYYMMDD``) that passed a point of a plan."""

    first: date

    @property
    def shards(self) -> set[str]:
        if self.rows == 0:
            return set()
        bits = self.observation.get["days"]
        days = (8 * at + bit for at, byte in enumerate(bits or b"") for bit in range(8) if byte >> bit & 1)
        return {date.fromordinal(self.first.toordinal() + n).strftime("%Y%m%d") for n in days}


def counted_days(df: DataFrame, shard: str, first: str) -> tuple[DataFrame, DayCount]:
    """Count rows and collect their day shards, a bit for each day from ``first`` on, while an action reads them.

    For the 32,768 days that Spark's bitmaps have bits for. Shards that are not named by a day
    are counted but not listed.
    """
    seen, day = Observation(), date(int(first[:4]), int(first[4:6]), int(first[6:8]))
    named = F.try_to_timestamp(F.col(shard), F.lit("yyyyMMdd")).cast("date")
    at = F.datediff(named, F.lit(day)) + 1  # bitmaps count from 1
    return df.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("days"),
    ), DayCount(seen, day)


def extract_shards(name: str, df: DataFrame, path: str, start: str, end: str, shard: str = "table_suffix",
                   rebalance: bool = False, **write_options) -> int:
    """Replace the day shards from ``start`` to ``end`` by those of ``df``, in one pass over it.

    Shards of the range that ``df`` has no rows for are emptied. Returns the rows written.
    """
    df.sparkSession.sparkContext.setJobDescription(f"extract {name}")
    watched, seen = counted_days(df.hint("rebalance", shard) if rebalance else df, shard, start)
    try:
        write_parquet(watched, path, partition_by=(shard,), replace="partitions", **write_options)
    finally:
        df.sparkSession.sparkContext.setJobDescription(None)
    delivered = seen.shards
    drop_partitions(df.sparkSession, path, shard, lambda value: (
        start <= value <= end and len(value) == 8 and value.isdigit() and value not in delivered))
    return seen.rows


def extract(name: str, df: DataFrame, path: str, partition_by: tuple[str, ...] = (),
            rebalance: bool = False, **write_options) -> int:
    """Write one table and return the rows written, without a second pass over the data."""
    df.sparkSession.sparkContext.setJobDescription(f"extract {name}")
    watched, seen = counted(df.hint("rebalance", *partition_by) if rebalance else df)
    try:
        write_parquet(watched, path, partition_by=partition_by, **write_options)
    finally:
        df.sparkSession.sparkContext.setJobDescription(None)
    return seen.rows


@dataclass(frozen=True)
class StoreLayout:
    """Where stored tables live and how they are split.

    Days split the tables, so a date filter reads only the days it needs. ``rebalance`` names
    the tables whose rows are shuffled by day before writing (see ``write_parquet``): new users
    always come out of a join by person, while events and products follow the delivery, which
    is clustered by day already.
    """

    database: str | None = None
    location: str | None = None
    by_day: bool = True
    rebalance: tuple[str, ...] = ("newusers",)

    def table(self, name: str) -> str:
        return f"{self.database}.{name}" if self.database else name

    def folder(self, spark: SparkSession) -> str:
        return self.location or base_folder(spark, self.database)


_DAY_COLUMN = {"events": "event_date", "products": "event_date", "newusers": "first_visit_date"}


def stage_table(df: DataFrame, name: str, layout: StoreLayout = StoreLayout(), shard: str | None = None,
                keep: Callable[[Spec], bool] | None = None, columns: Sequence[str] | None = None) -> Version:
    """Write the next version of a stored table; readers see it after its ``switch()``.

    ``shard`` names a further column that splits the table, so that a reloaded shard can replace its
    rows of whatever day. ``keep`` tells which partitions of the current version stay.
    """
    spark = df.sparkSession
    split = [_DAY_COLUMN[name]] if layout.by_day and name in _DAY_COLUMN else []
    split += [shard] if shard else []

    def write(rows: DataFrame, path: str) -> None:
        rows = rows.hint("rebalance", *split) if name in layout.rebalance else rows
        times_with_statistics(spark)
        _parquet_writer(rows, None, None, tuple(split), "all").parquet(path)

    return write_version(df, layout.table(name), layout.folder(spark), split, columns, keep, write)


def build_warehouse(spark: SparkSession, events: DataFrame, products: DataFrame,
                    newusers: DataFrame | None = None,
                    layout: StoreLayout = StoreLayout()) -> list[str]:
    """Create or replace the pruned report tables; returns the names that were built.

    All are written before the first is replaced, so readers have whole tables at any time, and
    the old ones when a build fails.
    """
    frames = {"events": events, "products": products, "newusers": newusers}
    staged = {
        name: stage_table(prune(df, STORED_COLUMNS[name]), name, layout)
        for name, df in frames.items() if df is not None
    }
    for version in staged.values():
        version.switch()
    return list(staged)


def ensure_warehouse(spark: SparkSession, load, layout: StoreLayout = StoreLayout()) -> list[str]:
    """Build the tables only if the main one is missing.

    ``load`` is called without arguments when a build is needed and returns the frames
    (events, products, newusers or None).
    """
    if has_table(spark, layout.table("events")):
        return []
    return build_warehouse(spark, *load(), layout=layout)


def previous_month(run_day: ColumnLike) -> tuple[Column, Column]:
    """First and last day of the full calendar month before each run day."""
    this_month = F.trunc(col(run_day), "MM")
    return F.add_months(this_month, -1), F.date_sub(this_month, 1)


def previous_month_range(run_day: Day) -> tuple[str, str]:
    """The same for one run day, as shard names: '2021-02-01' -> ('20210101', '20210131')."""
    first = as_day(run_day).replace(day=1)
    last = date.fromordinal(first.toordinal() - 1)
    return last.strftime("%Y%m01"), last.strftime("%Y%m%d")
