"""What several operators share: cutting lineage, holding out rows, and filters of a fixed size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a membership filter: 2 MB, whatever the corpus holds.
FILTER_BITS = 1 << 24
_BLOCK = 32768  # bits of one of Spark's bitmaps


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared checkpoint folder, so that lost executors cost nothing.

    Spark deletes the shuffle files of frames that are gone when the driver collects its garbage, which a driver with
    little to do seldom does. So it is asked to here: what came before an earlier cut then frees its disk.
    """
    context = df.sparkSession.sparkContext
    context._jvm.System.gc()
    if df.sparkSession.conf.get("spark.checkpoint.dir", None) is None and context.getCheckpointDir() is None:
        context.setCheckpointDir(_own_folder(df.sparkSession))
    return df.checkpoint()


def _own_folder(spark: SparkSession) -> str:
    """A folder of this machine, for local sessions such as tests; on a cluster the setting is needed."""
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="checkpoints-")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def remainder(id_column: str | Column, divisor: int) -> Column:
    """crc32 of an id written as text, modulo `divisor`; a null id counts as empty text."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % divisor


def filter_bit(key: Column) -> Column:
    """The bit of a membership filter that stands for `key`, a long that is a hash already."""
    return F.pmod(key, F.lit(FILTER_BITS))


def member_bits(keys: DataFrame, key: Column) -> bytes:
    """A bitmap of `FILTER_BITS` bits with the bit of each `key` of `keys` set; null keys have none.

    Testing a key against it may say yes wrongly, but never no, so it thins rows before an exact join. Only
    these bits reach the driver.
    """
    bit = filter_bit(key) + 1  # Spark's bitmaps count from 1
    blocks = (
        keys.where(key.isNotNull())
        .select(F.bitmap_bucket_number(bit).alias("block"), F.bitmap_bit_position(bit).alias("bit"))
        .groupBy("block")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .collect()
    )
    out = bytearray(FILTER_BITS // 8)
    for row in blocks:
        at = (row["block"] - 1) * (_BLOCK // 8)
        out[at : at + _BLOCK // 8] = row["bits"]
    return bytes(out)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, which every machine of the cluster sees."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _own_folder(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as Parquet in the shared folder, and read from there: only the columns asked for."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
