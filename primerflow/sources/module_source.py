"""``spark.read.format("module")``: the lines of module files, classified by Spark afterwards."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ModuleReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        found = system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith((".module", ".module.draft"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        with system.open_input_stream(partition.path) as f:
            text = f.read().decode()
        name = partition.path.rsplit("/", 1)[-1]
        for number, raw in enumerate(text.split("\n")):
            yield name, number + 1, raw


class ModuleSource(DataSource):
    """doc, ln, raw; a partition per file."""

    @classmethod
    def name(cls) -> str:
        return "module"

    def schema(self) -> str:
        return "doc string, ln int, raw string"

    def reader(self, schema) -> ModuleReader:
        return ModuleReader(self.options)


def read_modules(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ModuleSource)
    return spark.read.format("module").load(path)
