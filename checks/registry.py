"""Registered queries, each next to the SQL that must give the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, TimestampNTZType, TimestampType

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its name, with its SQL if SQL can express it."""
    def register(build: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            use_utc(spark)
            return portable(build(spark, folder))

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build
    return register


def use_utc(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def portable(df: DataFrame) -> DataFrame:
    """Dates and times as ISO text, so that two engines compare equal texts."""
    shown = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, DateType):
            c = c.cast("string").alias(field.name)
        elif isinstance(field.dataType, (TimestampType, TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(field.name)
        shown.append(c)
    return df.select(*shown)


def rounded(df: DataFrame, **places: int) -> DataFrame:
    """Round doubles: the named columns to the given places, the others to 6."""
    return df.select(*[
        F.round(f.name, places.get(f.name, 6)).alias(f.name)
        if isinstance(f.dataType, DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one the cluster names for intermediate tables."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="webmetrics-")
    return f"{base}/webmetrics/{name}-{uuid.uuid4().hex}"
