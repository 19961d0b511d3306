"""Day shards as a data source of their own: ``spark.read.format("webmetrics_shards")``.

Reads a folder of ``table_suffix=YYYYMMDD`` shards, as a warehouse exports them; each file is a
partition of the read. The range of shards is an option, so other days are not even listed. The
schema names the columns that are read.

Neither is left to Spark: it tells Python sources nothing of the columns that a query needs, and
Spark 4.1.2 keeps the filters that one query pushed down for other queries on the same frame, which
then lack rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SHARD = "table_suffix"
NAME = "webmetrics_shards"


class ShardReader(DataSourceReader):
    def __init__(self, path: str, start: str | None, end: str | None, schema: StructType):
        self.path, self.start, self.end, self.schema = path, start, end, schema

    def _wanted(self, shard: str) -> bool:
        return (self.start is None or shard >= self.start) and (self.end is None or shard <= self.end)

    def partitions(self) -> list[InputPartition]:
        files, root = fs.FileSystem.from_uri(self.path)
        found = []
        for folder in files.get_file_info(fs.FileSelector(root)):
            name, _, shard = folder.base_name.partition("=")
            if name == SHARD and self._wanted(shard):
                inside = files.get_file_info(fs.FileSelector(folder.path, recursive=True))
                found += [(f.path, shard) for f in inside if f.is_file and f.base_name.endswith(".parquet")]
        return [InputPartition(f) for f in sorted(found)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no shard is in the range
            return
        path, shard = partition.value
        files, _ = fs.FileSystem.from_uri(self.path)
        wanted = to_arrow_schema(self.schema)
        stored = pa.schema([f for f in wanted if f.name != SHARD])
        for batch in ds.dataset(path, filesystem=files, format="parquet", schema=stored).to_batches():
            columns = {**dict(zip(batch.schema.names, batch.columns)), SHARD: pa.array([shard] * batch.num_rows, pa.string())}
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in wanted], schema=wanted)


class ShardSource(DataSource):
    """Options: ``path`` (what pyarrow opens, on all machines the same), ``start`` and ``end`` (both
    included). The schema has to be given."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def reader(self, schema: StructType) -> DataSourceReader:
        return ShardReader(self.options["path"], self.options.get("start"), self.options.get("end"), schema)


def read_shards(spark: SparkSession, path: str, schema: StructType | str, start: str | None = None,
                end: str | None = None) -> DataFrame:
    """The shards from ``start`` to ``end``; without a bound, all on that side."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # machines need no copy of the library
    spark.dataSource.register(ShardSource)
    bounds = {name: value for name, value in (("start", start), ("end", end)) if value is not None}
    return spark.read.format(NAME).schema(schema).options(path=path, **bounds).load()
