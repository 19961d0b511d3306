"""Readers. Each returns a lazy DataFrame; pruning and pushdown are left to Catalyst."""

from __future__ import annotations

from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from webmetrics.schema import DEFAULT_DAY, RAW_EVENT_SCHEMA

TEMPLATES = Path(__file__).resolve().parent.parent / "templates"


def in_shards(raw: DataFrame, start: str = DEFAULT_DAY, end: str | None = None) -> DataFrame:
    """Keep day shards from start to end, both included; without an end, the start only."""
    if end is None:
        return raw.where(F.col("table_suffix") == start)
    return raw.where(F.col("table_suffix").between(start, end))


def read_raw_events(spark: SparkSession, base: str, start: str = DEFAULT_DAY,
                    end: str | None = None,
                    schema: StructType = RAW_EVENT_SCHEMA) -> DataFrame:
    """Raw records stored as ``base/table_suffix=YYYYMMDD``; other days are never listed.

    The schema is given, so day names stay text and no file is opened to infer it.
    """
    return in_shards(spark.read.schema(schema).parquet(base), start, end)


def read_source(spark: SparkSession, fmt: str, schema: StructType | None = None,
                **options) -> DataFrame:
    """Any Spark connector by name, e.g. ``parquet``, ``jdbc`` or ``bigquery``."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load()


def read_table_path(spark: SparkSession, path: str,
                    schema: StructType | None = None) -> DataFrame:
    reader = spark.read
    return (reader.schema(schema) if schema is not None else reader).parquet(path)


def template_text(name: str) -> str:
    return (TEMPLATES / f"{name}.sql").read_text(encoding="utf-8")


def run_template(spark: SparkSession, name: str, **params) -> DataFrame:
    """Run a stored query with named parameters.

    Parameters are bound as values (``:start``), table names through ``IDENTIFIER(:source)``;
    nothing is pasted into the text.
    """
    return spark.sql(template_text(name), args=params)


def has_table(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def open_table(spark: SparkSession, name: str, cache: bool = False) -> DataFrame:
    table = spark.table(name)
    return materialize(table) if cache else table


def open_optional(spark: SparkSession, name: str) -> DataFrame | None:
    """The table if it was built, else None, so that its report can be left out."""
    return open_table(spark, name) if has_table(spark, name) else None


def materialize(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Keep the used columns in memory across several reports; spills to executor disk.

    Meant for a frame that is read repeatedly. Release it with ``unpersist()``.
    """
    return (df.select(*columns) if columns else df).persist(StorageLevel.MEMORY_AND_DISK)
