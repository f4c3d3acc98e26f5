"""``spark.read.format("veriframe_reads")``: the lines that a registered reader finds in the files of a folder.

Options: ``path``; ``reader`` (a name given to ``connectors.register_reader``; "text" if left out); ``partitionbytes`` (files are put together up to
about that size). A file is a record, and a partition some files, so the work grows with the folder and is split by Spark.
Of a schema with fewer columns only those are made. Files are read one at a time, and given on in batches of ``ROWS`` lines; a reader that streams
(see ``connectors``) never holds one whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from veriframe.sources.connectors import LINES, reader
from veriframe.sources.folders import listed, located

NAME = "veriframe_reads"
PARTITION_BYTES = 16 << 20
ROWS = 10_000


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.schema = options["path"], schema
        self.factory = reader(options.get("reader", "text"))
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))
        self.scheme = self.path.partition("://")[0] + "://" if "://" in self.path else ""

    def partitions(self) -> list[InputPartition]:
        groups, size = [[]], 0
        for file in listed(self.path):
            if groups[-1] and size + file.size > self.most:
                groups, size = [*groups, []], 0
            groups[-1].append(file.path)
            size += file.size
        return [_Files(paths) for paths in groups]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        lines_of, schema = self.factory(), to_arrow_schema(self.schema)
        for path in partition.paths:
            system, at = located(f"{self.scheme}{path}" if self.scheme != "file://" else path)
            with system.open_input_stream(at) as file:
                lines = lines_of.stream(file) if hasattr(lines_of, "stream") else lines_of(file.read())
                rows = ({"record_id": path, "line_id": i, **line} for i, line in enumerate(lines))
                for some in batched(rows, ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in some], f.type) for f in schema], schema=schema)


class ReadsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return LINES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ReadsSource)
