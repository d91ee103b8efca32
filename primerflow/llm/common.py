"""What the operators share: the shared folder, tables written to cut lineage, Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: arrays of a MB or more go back to the system when they are freed
except (OSError, AttributeError):  # another C library: memory is as it comes there
    _LIBC = None


def release() -> None:
    """Gives freed memory back to the system: Python workers live as long as their executor."""
    pa.default_memory_pool().release_unused()
    if _LIBC:
        _LIBC.malloc_trim(0)


#: Rows that are handled at once. Spark bounds Arrow batches by bytes (``spark.sql.execution.arrow.maxBytesPerBatch``) and
#: by rows; operators take those in slices and leave the session's settings alone.
BATCH_ROWS = 2048


#: What modules do to drop what their tasks keep in a worker for further ones.
DROPS: list[Callable[[], None]] = []


def forget() -> None:
    for drop in DROPS:
        drop()


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, keeps: bool = False) -> DataFrame:
    """``df.mapInArrow`` by slices of ``BATCH_ROWS`` rows, with a release of memory behind each task. A worker goes from one
    operator's tasks to another's: tasks first drop what is registered in ``DROPS``, unless they go on with it (``keeps``)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            if not keeps:
                forget()
            yield from run(b.slice(k, BATCH_ROWS) for b in batches for k in range(0, b.num_rows, BATCH_ROWS))
        finally:
            release()

    return df.mapInArrow(task, schema)


#: Folders of applications that have one already.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir`` of the session, with its scheme.

    Where the setting is missing and all tasks run on this machine, a temporary folder takes its place; a cluster without
    it is an error, since its executors would write to their own disks.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        base = tempfile.gettempdir()
    if "://" not in base:  # a bare path is on the default file system
        path = context._jvm.org.apache.hadoop.fs.Path(base)
        base = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
        base = "file://" + base.removeprefix("file:") if base.startswith("file:/") and not base.startswith("file://") else base
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the application's part of the shared folder, which goes when the driver's JVM ends."""
    name = spark.sparkContext.applicationId
    if name not in _OWN:
        own = f"{shared_dir(spark)}/primerflow-{name}-{uuid.uuid4().hex[:8]}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _OWN[name] = own
    return f"{_OWN[name]}/{tag}-{uuid.uuid4().hex}"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def move(system: fs.FileSystem, source: str, target: str) -> None:
    """Gives a finished file its name. Where a task that ran twice has left the same file under it, that one stays."""
    try:
        system.move(source, target)
    except OSError:
        if system.get_file_info(target).type != fs.FileType.File:
            raise
        system.delete_file(source)


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: lineage is cut and no executor is its only home."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_batch(df: DataFrame, build: Callable[[pa.RecordBatch], dict], schema: str, keeps: bool = False) -> DataFrame:
    """``build`` on each Arrow batch of ``df``; it returns the columns of ``schema`` by name. ``keeps``: see ``mapped``."""
    names, types = arrow_fields(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = build(batch)
                yield pa.RecordBatch.from_arrays([to_arrow(out[n], t) for n, t in zip(names, types)], names)

    return mapped(df, run, schema, keeps)


def to_arrow(values, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, kind)


def arrow_fields(spark: SparkSession, schema: str) -> tuple[list[str], list[pa.DataType]]:
    """Names and Arrow types of a DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema))
    return list(fields.names), list(fields.types)


def texts_of(column: pa.Array) -> list[str]:
    """Strings of a column, null as the empty string."""
    return [x or "" for x in column.to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column, null as none."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns: further ones, also with names that an operator uses, can't clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_keys(docs: DataFrame, d: str = "d", h: str = "h") -> DataFrame:
    """``docs`` with two columns that name a row by id and text, null ids apart from others."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({d: F.coalesce("doc_id", F.lit(0)).cast("long"), h: F.xxhash64(text, F.col("doc_id").isNull())})


#: Names of these columns beside all columns of a table.
ROW_KEY = ("__row_d", "__row_h")
