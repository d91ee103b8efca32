"""Assets, dictionaries, drift and resumption: joins against what exists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def references(lines: DataFrame) -> DataFrame:
    """doc, name of every asset token in lines (doc, raw), repeats included; timings dropped."""
    tokens = F.regexp_extract_all("raw", F.lit(r"\{\s*([^{}]+?)\s*\}"), 1)
    names = lines.select("doc", F.explode(tokens).alias("t")).select("doc", T.trim(F.split("t", "@", -1)[0]).alias("name"))
    return names.where(F.col("name").rlike(T.AUDIO) | F.col("name").rlike(T.IMAGE))


def first_existing(names: DataFrame, listing: DataFrame, folders: list[str], extensions: list[str]) -> DataFrame:
    """name, path: of the candidates of each name (folders by extensions, in order), the first that the listing has."""
    base = F.regexp_replace("name", r"\.[^.]+$", "")
    made = F.array(*[F.struct(F.lit(k).alias("place"), F.concat(F.lit(f), base, F.lit(x)).alias("path")) for k, (f, x) in enumerate((f, x) for f in folders for x in extensions)])
    candidates = names.select("name").distinct().select("name", F.explode(made).alias("c")).select("name", "c.*")
    return candidates.join(listing.select("path").distinct(), "path").groupBy("name").agg(F.min_by("path", "place").alias("path"))


def missing_counts(refs: DataFrame, existing: DataFrame) -> DataFrame:
    """doc, n: references to assets that don't exist, repeats counted."""
    return refs.join(existing.select("name"), "name", "left_anti").groupBy("doc").agg(F.count("*").alias("n"))


def drift(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """name, state: same, changed, missing or extra, by the hash of the content."""
    a, b = (d.select("name", F.sha2("content", 256).alias(h)) for d, h in ((ours, "a"), (theirs, "b")))
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return a.join(b, "name", "full").select("name", state.alias("state"))


def to_translate(rows: DataFrame, columns: list[str], done: DataFrame) -> DataFrame:
    """``en``: distinct non-empty strings of some columns that the dictionary lacks."""
    return rows.select(F.explode(F.array(*columns)).alias("en")).where("en <> ''").distinct().join(done.select("en"), "en", "left_anti")


def translated(rows: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """rows with ``other``: the dictionary's entry, null without (J08). The optimizer broadcasts it where it is small."""
    return rows.join(dictionary.select(F.col("en").alias(column), "other"), column, "left")


def pending(inputs: DataFrame, outputs: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Inputs without an output of the same key and producer."""
    return inputs if force else inputs.join(outputs.select(*keys).distinct(), keys, "left_anti")


def zipped(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Arrays ``a`` and ``b`` of each key side by side, with whether their lengths agree."""
    both = left.join(right, keys)
    same = F.size("a") == F.size("b")
    return both.select(*keys, same.alias("ok"), F.when(same, F.arrays_zip("a", "b")).alias("pairs"))


def distinct_union(*names: DataFrame) -> DataFrame:
    """The distinct rows of several tables."""
    out = names[0]
    for more in names[1:]:
        out = out.union(more)
    return out.distinct()


def unknown_clip_lines(lines: DataFrame, sources: DataFrame) -> DataFrame:
    """doc, ln, raw of lines with a clip that no line of a source module equals, edges trimmed (J09). The same clip lines
    recur in many modules, so sources are made distinct first."""
    clip = F.col("raw").rlike(r"\{[^{}]*\.mp3\s*\}")
    known = sources.where(clip).select(T.trim(F.col("raw")).alias("line")).distinct()
    return lines.where(clip).withColumn("line", T.trim(F.col("raw"))).join(known, "line", "left_anti").select("doc", "ln", "raw")


def file_tokens(docs: DataFrame) -> DataFrame:
    """doc, name of every ``{file.ext}`` token of whole texts, repeats included; one with a timing or a space isn't a file."""
    return docs.select("doc", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\{\s*([^{}@\s]+\.[A-Za-z0-9]+)\s*\}"), 1)).alias("name"))


def copy_plan(refs: DataFrame, listing: DataFrame) -> DataFrame:
    """name, source, target, state: what to copy where, and what is missing (K09). The copying itself is the caller's."""
    found = listing.groupBy("name").agg(F.min("path").alias("source"))
    out = refs.select("name").distinct().join(found, "name", "left")
    folder = F.when(F.col("name").rlike(T.AUDIO), "audio/").otherwise("images/")
    return out.select("name", "source", F.when(F.col("source").isNotNull(), F.concat(folder, "name")).alias("target"), F.when(F.col("source").isNull(), "missing").otherwise("copied").alias("state"))


def first_match(rows: DataFrame, keys: list[str], order: Column, wanted: Column) -> DataFrame:
    """Of each key the first row in order that is wanted."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.where(wanted).withColumn("__n", first).where("__n = 1").drop("__n")
