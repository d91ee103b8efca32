"""Sources of lesson material: text and JSON files, lesson books, scripts, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..operators.module import lines

TRANSCRIPT = "info STRUCT<source:STRING,model:STRING>, segments ARRAY<STRUCT<id:INT,start:DOUBLE,end:DOUBLE,text:STRING,words:ARRAY<STRUCT<start:DOUBLE,end:DOUBLE,word:STRING>>>>"


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def base_name(path: Column) -> Column:
    return F.regexp_extract(F.url_decode(path), r"([^/]+)$", 1)


def texts(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """doc, text of whole files (S01, S02, S04): carriage returns stay. A missing folder gives no rows."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "doc string, text string")
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return reader.text(path, wholetext=True).select(base_name(F.col("_metadata.file_path")).alias("doc"), F.col("value").alias("text"))


def listing(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, name, size_kb, modified of files (S20, S21); contents aren't read. A missing folder gives no rows."""
    schema = "path string, name string, size_kb double, modified timestamp"
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return found.select("path", base_name(F.col("path")).alias("name"), (F.col("length") / 1024).alias("size_kb"), F.col("modificationTime").alias("modified"))


def markdown_inputs(files: DataFrame, like: str = "") -> DataFrame:
    """Files to convert: Markdown, without download markers, names that contain ``like`` in any case."""
    name = F.col("doc")
    keep = name.endswith(".md") & ~name.contains("Zone.Identifier")
    return files.where(keep & F.lower(name).contains(like.lower())) if like else files.where(keep)


def configs(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """name and fields of JSON configuration files."""
    return spark.read.schema(schema).json(path, multiLine=True).select(base_name(F.col("_metadata.file_path")).alias("name"), "*")


def or_default(value: Column, default, rule: str = "missing") -> Column:
    """A setting's default by one of three rules: for null (``missing``), also for 0 and "" (``falsy``), or only where the
    key is absent, so that null stays (``kept``: the caller says with a null default)."""
    if rule == "kept":
        return value
    if rule == "falsy":
        value = F.when(~value.cast("string").isin("", "0", "0.0"), value)
    return F.coalesce(value, F.lit(default))


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """name, seg, word_no, word, start, end of transcript files (S06); none for a missing folder."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "name string, seg int, word_no int, word string, start double, end double")
    files = spark.read.schema(TRANSCRIPT).json(path, multiLine=True).select(base_name(F.col("_metadata.file_path")).alias("name"), F.posexplode("segments").alias("seg", "s"))
    return files.select("name", "seg", F.posexplode("s.words").alias("word_no", "w")).select("name", "seg", "word_no", "w.word", "w.start", "w.end")


def lesson_book(files: DataFrame) -> DataFrame:
    """doc, fig, instruction, items of lesson Markdown (S09, W10): the first lesson of a file; a figure's first bold line,
    its numbered images and texts."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc").orderBy("ln")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines(files).withColumn("raw", F.regexp_replace("raw", "\r$", ""))
    heading, figure = rf"(?i)^#{T.SPACE}+.*LESSON{T.SPACE}+([0-9]+[A-D])", rf"(?i)^##{T.SPACE}+Figure{T.SPACE}+(\d+)"
    rows = rows.withColumn("block", F.sum(F.col("raw").rlike(heading).cast("int")).over(upto)).where("block <= 1")
    number = F.when(F.col("raw").rlike(figure), F.regexp_extract("raw", figure, 1).cast("int"))
    rows = rows.withColumn("fig_ln", F.last(F.when(number.isNotNull(), F.col("ln")), ignorenulls=True).over(upto)).withColumn("fig", F.last(number, ignorenulls=True).over(upto)).where("fig IS NOT NULL")
    bold, item, image = r"^\*\*(.+?)\*\*\s*$", r"^(\d+)\.\s+(.*)$", r"!\[([^\]]*)\]\(([^)]+)\)"
    rest = F.regexp_extract("raw", item, 2)
    alt = F.regexp_extract(rest, image, 1)
    panel = T.or_null(F.regexp_extract(alt, r"^#(\d+)", 1)).cast("int")
    shown = F.when(rest.rlike(image), F.struct(T.trim(F.regexp_extract(rest, image, 2)).alias("path"), panel.alias("panel"), T.trim(F.regexp_replace(alt, r"^#\d+\s*", "")).alias("caption")))
    entry = F.when(F.col("raw").rlike(item), F.struct("ln", F.regexp_extract("raw", item, 1).cast("int").alias("index"), shown.alias("image"), F.when(~rest.rlike(image), T.trim(rest)).alias("text")))
    told = F.when(F.col("raw").rlike(bold), F.col("ln"))
    return rows.groupBy("doc", "fig_ln", "fig").agg(F.min_by(T.trim(F.regexp_extract("raw", bold, 1)), told).alias("instruction"), F.sort_array(F.collect_list(entry)).alias("items")).drop("fig_ln")


def tape_scripts(files: DataFrame, lesson: str) -> DataFrame:
    """fig, text of a lesson's tape script (S10, P52, W09, A06). files: file_order, text. The first file whose heading of the
    lesson has AUDIO TRACK soon after counts; its body ends at the end marker, else at the next lesson, else with the file."""
    head, nxt = rf"(?im)^#{{1,4}}\s*Lesson\s*{lesson}\b.*$", r"(?im)^#{1,4}\s*Lesson\s*\d[A-D]\b"
    title = F.regexp_substr("text", F.lit(head))
    found = files.withColumn("title", title).where("title IS NOT NULL").withColumn("body", F.expr("substring(text, instr(text, title))"))
    found = found.where(F.upper(F.substring("body", 1, 600)).contains("AUDIO TRACK"))
    first = found.agg(F.min_by(F.struct("body", "title"), "file_order").alias("b")).select("b.*").where("body IS NOT NULL")
    end = F.regexp_instr("body", F.lit(rf"(?i)END OF LESSON\s*{lesson}\b"))
    after = F.expr("substring(body, length(title) + 1)")
    follows = F.regexp_instr(after, F.lit(nxt))
    body = F.when(end > 0, F.expr("substring(body, 1, stop - 1)")).when(F.col("follows") > 0, F.expr("substring(body, 1, length(title) + follows - 1)")).otherwise(F.col("body"))
    blocks = first.withColumn("stop", end).withColumn("follows", follows).select(F.posexplode(T.split_sections(body, r"#{0,4}\s*\**AUDIO TRACK\b.*")).alias("n", "block"))
    # a lesson's blocks are few: one window over them
    from pyspark.sql import Window

    number = T.or_null(F.regexp_extract("block", r"(?i)Figure\s*(\d+)", 1)).cast("int")
    upto = Window.partitionBy(F.lit(lesson)).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = blocks.withColumn("fig", F.last(number, ignorenulls=True).over(upto)).where("fig IS NOT NULL")
    return placed.groupBy("fig").agg(F.array_join(F.sort_array(F.collect_list(F.struct("n", "block")))["block"], "\n\n").alias("text"))
