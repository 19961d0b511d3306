"""Exact duplicates: groups by a 128-bit content hash, with the texts themselves compared inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: White space that does not count, `[\x20\x09-\x0D]`.
SPACES = " \t\n\x0b\f\r"


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def exact_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    content_hash: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One row per row of `docs`: its id, `keep_id`, `group_size`, `kept` and `text_sha256`.

    Texts are equal when their normalised forms are. Of equal texts the row with the most code points stays,
    then the one with the smallest id. The hash and a few numbers per row are kept once, in the checkpoint
    folder; then the distinct (hash, text) pairs, which Spark compares byte by byte and combines before the
    shuffle, show the hashes that several texts share. Only rows of such a hash are grouped by the text itself.

    Null text: empty, and all empty texts are one group. Null ids come after all others, and are nobody's
    `keep_id` unless every id of the group is null. Rows repeated with their id stay or go together. Other
    columns are ignored. No rows in, no rows out.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    hashed = rows.select("doc_id", F.char_length("text").alias("n"), normalised(F.col("text")).alias("body"))
    hashed = hashed.withColumn("hash", content_hash(F.col("body")))
    narrow = cut(hashed.select("doc_id", "n", "hash", F.sha2("body", 256).alias("text_sha256")))
    shared = cut(hashed.select("hash", "body").distinct().groupBy("hash").count().where("count > 1").select("hash"))
    clean = _judged(narrow.join(shared, "hash", "left_anti"), ["hash"])
    if shared.isEmpty():
        return clean
    collided = hashed.join(shared, "hash", "left_semi").withColumn("text_sha256", F.sha2("body", 256))
    return clean.unionByName(_judged(collided, ["hash", "body"]))


def _judged(rows: DataFrame, key: list[str]) -> DataFrame:
    """The row that stays of each key, joined to all rows; a hot key is a skewed join, which Spark splits."""
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id"))
    groups = rows.groupBy(*key).agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    any_id = F.coalesce(F.col("best.doc_id"), F.lit(None))
    groups = groups.select(*key, any_id.alias("keep_id"), "group_size")
    return rows.join(groups, key).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
