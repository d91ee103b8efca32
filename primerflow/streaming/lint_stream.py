"""Linting as files change, and sessions of timed words on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lint import lint
from ..sources.files import base_name


def watch_modules(spark: SparkSession, path: str) -> DataFrame:
    """doc, modified, text of module files as they appear."""
    files = spark.readStream.option("wholetext", "true").text(path)
    return files.select(base_name(F.col("_metadata.file_path")).alias("doc"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))


def lint_changes(modules: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Lints each batch of changed modules (T01). A batch writes one folder under its own number, so running it again
    changes nothing; ``newest`` reads the last result of each document."""

    def batch(docs: DataFrame, number: int) -> None:
        last = docs.groupBy("doc").agg(F.max_by(F.struct("text", "modified"), "modified").alias("d")).select("doc", "d.*")
        found = last.join(lint(last.select("doc", "text")), "doc", "left").drop("text").withColumn("batch", F.lit(number))
        found.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return modules.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, target: str) -> DataFrame:
    """Diagnostics of the last batch of each document."""
    rows = spark.read.parquet(target)
    last = F.max("batch").over(Window.partitionBy("doc"))
    return rows.withColumn("__last", last).where("batch = __last AND code IS NOT NULL").drop("__last")


def gap_sessions(words: DataFrame, keys: list[str], gap: str = "1500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """keys, start, end, n of sessions by pause alone (T07): event time ``at``, late words dropped after the watermark."""
    session = F.session_window("at", gap)
    return words.withWatermark("at", late).groupBy(*keys, session).agg(F.count("*").alias("n")).select(*keys, "session_window.start", "session_window.end", "n")
