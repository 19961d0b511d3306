"""Seeded purchase rows: every value is a function of (id, seed), never of partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webmetrics.schema import (
    PURCHASE_CATEGORIES,
    PURCHASE_DEPARTMENTS,
    PURCHASE_STATUSES,
    PURCHASES_SCHEMA,
)

PRIME = 2147483647  # 2^31 - 1: products of two residues fit a BIGINT
MULTIPLIER = 48271
SUPPLIERS = 50
YEARS = 7
CHUNK = 1_000_000
SEED = 42


def uniform(row_id: Column, seed: int, stream: int) -> Column:
    """A residue spread over 0 .. PRIME-1; streams are unrelated draws for one id.

    Plain BIGINT arithmetic, so any SQL engine reproduces it.
    """
    x = (row_id * MULTIPLIER + (seed * 69621 + stream * 1299709)) % PRIME
    for step in (7919, 104729):
        x = (x * x + x * step + stream) % PRIME
    return x


def fill_purchases(ids: DataFrame, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """Purchases for the ids in column ``purchase_id``; years cycle within each chunk."""
    pid = F.col("purchase_id")

    def below(n: int, stream: int) -> Column:
        return (uniform(pid, seed, stream) % n).cast("int")

    def real(low: float, high: float, stream: int) -> Column:
        return F.lit(low) + uniform(pid, seed, stream).cast("double") / float(PRIME) * (high - low)

    def choice(values: tuple[str, ...], stream: int) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), below(len(values), stream) + 1)

    columns = {
        "purchase_id": pid,
        "year": F.lit(2020) + F.pmod(F.pmod(pid - 1, F.lit(chunk)), F.lit(YEARS)).cast("int"),
        "supplier": F.concat(F.lit("Supplier_"), (below(SUPPLIERS, 1) + 1).cast("string")),
        "item_category": choice(PURCHASE_CATEGORIES, 2),
        "quantity": below(999, 3) + 1,
        "unit_price": real(10.0, 500.0, 4),
        "purchase_amount": real(100.0, 50000.0, 5),
        "department": choice(PURCHASE_DEPARTMENTS, 6),
        "status": choice(PURCHASE_STATUSES, 7),
    }
    return ids.select(*[
        columns[f.name].cast(f.dataType).alias(f.name) for f in PURCHASES_SCHEMA.fields
    ])


def gen_purchases(spark: SparkSession, n: int, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """``n`` purchases with ids 1 .. n."""
    return fill_purchases(spark.range(1, n + 1).withColumnRenamed("id", "purchase_id"),
                          seed, chunk)
