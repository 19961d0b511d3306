"""Tables that are replaced while others read them.

What readers open is a view. A build writes its rows beside the current ones, as a table of its own
that also lists the partitions it takes over from the current version, where they are. Only then the
view is pointed at it, which is one change of metadata: readers see the table as it was or as it is,
also when a build fails half-way. A build that replaces some partitions writes nothing else.

Versions of one table follow one another; two builds of it at once would lose one's changes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

from webmetrics.sources.scan import has_table

Spec = dict[str, str | None]

_PROPERTY = "webmetrics.version"
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
_AT_ONCE = 500  # partitions in a statement


def quoted(name: str) -> str:
    return ".".join(f"`{part}`" for part in name.split("."))


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def parsed(spec: str) -> Spec:
    """``day=2021-01-01/shard=20210101`` as column to value; a missing value is None."""
    pairs = (part.split("=", 1) for part in spec.split("/"))
    return {unquote(name): None if value == _NO_VALUE else unquote(value) for name, value in pairs}


def _clause(spec: str) -> str:
    return "PARTITION (" + ", ".join(
        f"`{name}` = {'NULL' if value is None else _text(value)}" for name, value in parsed(spec).items()) + ")"


def base_folder(spark: SparkSession, database: str | None) -> str:
    """Where a database keeps its tables."""
    name = database or spark.catalog.currentDatabase()
    return spark.catalog.getDatabase(name).locationUri.rstrip("/")


@dataclass(frozen=True)
class Version:
    """Rows of table ``name`` that readers do not see yet. ``written`` has the partitions that are
    new, ``taken_over`` those of the version before."""

    spark: SparkSession
    name: str
    table: str
    columns: tuple[str, ...]
    manifest: str
    written: tuple[str, ...] = ()
    taken_over: tuple[str, ...] = ()

    def rows(self) -> DataFrame:
        """All rows of this version, partition columns included."""
        return self.spark.table(self.table)

    def switch(self) -> str:
        """Let readers see this version; returns the table's name."""
        shown = ", ".join(f"`{c}`" for c in self.columns)
        if has_table(self.spark, self.name) and self.spark.catalog.getTable(self.name).tableType != "VIEW":
            # A table from elsewhere keeps its rows under another name.
            self.spark.sql(f"ALTER TABLE {quoted(self.name)} RENAME TO {quoted(f'{self.table}_before')}")
        self.spark.sql(
            f"CREATE OR REPLACE VIEW {quoted(self.name)} "
            f"TBLPROPERTIES ('{_PROPERTY}' = {_text(self.table)}, '{_PROPERTY}.manifest' = {_text(self.manifest)}) "
            f"AS SELECT {shown} FROM {quoted(self.table)}")
        return self.name


def _properties(spark: SparkSession, name: str) -> dict[str, str]:
    if not has_table(spark, name):
        return {}
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {quoted(name)}").collect()}


def current_rows(spark: SparkSession, name: str) -> DataFrame | None:
    """All columns of the version that readers see, also those the view leaves out; None without one."""
    table = _properties(spark, name).get(_PROPERTY)
    return None if table is None else spark.table(table)


def partition_folders(spark: SparkSession, name: str) -> dict[str, str]:
    """The folder of each partition that readers see. There are as many as days, so they fit the driver."""
    manifest = _properties(spark, name).get(f"{_PROPERTY}.manifest")
    return {} if not manifest else {r["spec"]: r["folder"] for r in spark.read.parquet(manifest).collect()}


def write_version(df: DataFrame, name: str, folder: str, partition_by: Sequence[str] = (),
                  columns: Iterable[str] | None = None,
                  keep: Callable[[Spec], bool] | None = None,
                  write: Callable[[DataFrame, str], None] | None = None,
                  buckets: tuple[int, Sequence[str]] | None = None) -> Version:
    """Write ``df`` as the next version of table ``name`` below ``folder``.

    ``keep`` tells which partitions of the current version stay; without it none does. ``columns``
    are those the view shows (all by default). ``write`` writes a frame to a path, split by
    ``partition_by``; the files' format is Parquet. ``buckets`` (number, columns) splits an
    unpartitioned table further, each bucket sorted.
    """
    spark = df.sparkSession
    short = name.split(".")[-1]
    version = f"{short}__{uuid.uuid4().hex}"
    table = ".".join([*name.split(".")[:-1], version])
    place = f"{folder}/{short}.versions/{version}"
    path, manifest = f"{place}/rows", f"{place}/partitions"
    shown = tuple(columns) if columns is not None else tuple(df.columns)
    if buckets is not None:
        number, by = buckets
        df.write.format("parquet").option("path", path).bucketBy(number, *by).sortBy(*by).saveAsTable(table)
        return Version(spark, name, table, shown, "")
    if write is not None:
        write(df, path)
    else:
        df.write.partitionBy(*partition_by).parquet(path)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    split = f"PARTITIONED BY ({', '.join(f'`{c}`' for c in partition_by)})" if partition_by else ""
    spark.sql(f"CREATE TABLE {quoted(table)} ({fields}) USING parquet {split} LOCATION {_text(path)}")
    if not partition_by:
        return Version(spark, name, table, shown, "")
    spark.sql(f"ALTER TABLE {quoted(table)} RECOVER PARTITIONS")
    written = tuple(r[0] for r in spark.sql(f"SHOW PARTITIONS {quoted(table)}").collect())
    before = partition_folders(spark, name) if keep else {}
    if any(set(parsed(spec)) != set(partition_by) for spec in before):
        raise ValueError(f"{name} is not split by {', '.join(partition_by)}, so its partitions cannot be kept")
    taken = {spec: place for spec, place in before.items() if keep(parsed(spec)) and spec not in written}
    specs = sorted(taken)
    for at in range(0, len(specs), _AT_ONCE):
        parts = " ".join(f"{_clause(s)} LOCATION {_text(taken[s])}" for s in specs[at:at + _AT_ONCE])
        spark.sql(f"ALTER TABLE {quoted(table)} ADD {parts}")
    places = {spec: f"{path}/{spec}" for spec in written} | taken
    spark.createDataFrame(sorted(places.items()), "spec STRING, folder STRING") \
        .coalesce(1).write.parquet(manifest)
    return Version(spark, name, table, shown, manifest, written, tuple(specs))


def clean(spark: SparkSession, name: str, folder: str) -> list[str]:
    """Delete what no reader of ``name`` can see any more: older versions and those of failed builds.

    Not for times when a build runs or a reader still works on an older version. Partitions that the
    current version took over stay where they are. Returns the folders deleted.
    """
    short, found = name.split(".")[-1], _properties(spark, name)
    table, places = found.get(_PROPERTY), partition_folders(spark, name).values()
    if table is None:
        return []
    database = ".".join(name.split(".")[:-1])
    for row in spark.sql(f"SHOW TABLES {f'IN {quoted(database)}' if database else ''} LIKE '{short}__*'").collect():
        other = ".".join([*([database] if database else []), row["tableName"]])
        if other.lower() != table.lower() and len(row["tableName"]) == len(short) + 34:
            spark.sql(f"DROP TABLE {quoted(other)}")  # external: the files are seen to below
    used = {place.rsplit("/rows/", 1)[0].rsplit("/", 1)[-1] for place in places} | {table.split(".")[-1]}
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{short}.versions")
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for status in files.listStatus(root):
        if status.getPath().getName() not in used and status.getPath().getName().startswith(f"{short}__"):
            files.delete(status.getPath(), True)
            gone.append(status.getPath().toString())
    return gone
