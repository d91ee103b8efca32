"""Sinks: texts by document, manifests, side outputs for errors, split and combined documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def write_texts(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A text per document, below a folder of its name."""
    rows.select("doc", "text").write.mode(mode).partitionBy("doc").text(path)


def write_with_errors(rows: DataFrame, path: str) -> None:
    """Rows with ``error`` go beside the others, which they don't stop (K03). A path is of one run: a rerun replaces it."""
    rows.where("error IS NULL").drop("error").write.mode("overwrite").parquet(f"{path}/ok")
    rows.where("error IS NOT NULL").write.mode("overwrite").parquet(f"{path}/error")


def manifest(lessons: DataFrame, segments: DataFrame, fps: int = 30, width: int = 1920, height: int = 1080) -> DataFrame:
    """lesson, json: lessons with their segments in order under a header (K04). A row per lesson: no single task holds them all."""
    order = F.sort_array(F.collect_list(F.struct("seg_no", *[c for c in segments.columns if c not in ("lesson", "seg_no")])))
    nested = segments.groupBy("lesson").agg(order.alias("segments"))
    body = F.struct(F.lit(fps).alias("fps"), F.lit(width).alias("width"), F.lit(height).alias("height"), "lesson", "title", "segments")
    return lessons.join(nested, "lesson", "left").select("lesson", F.to_json(body).alias("json"))


def combine(chunks: DataFrame) -> DataFrame:
    """book, text, missing: chunks in order between rule lines, and the starts of those that have failed."""
    parts = F.sort_array(F.collect_list(F.struct("start", "text")))
    ok = F.filter(parts, lambda p: p["text"].isNotNull())
    bad = F.filter(parts, lambda p: p["text"].isNull())
    return chunks.groupBy("book").agg(F.array_join(ok["text"], "\n\n---\n\n").alias("text"), bad["start"].alias("missing"))


def split_documents(docs: DataFrame, marker: str, existing: DataFrame) -> DataFrame:
    """doc, name, text of the parts of documents: numbered, with the first heading; parts that exist are left out."""
    parts = docs.select("doc", F.posexplode(T.split_sections(F.col("text"), marker)).alias("k", "text"))
    title = T.file_title(F.regexp_extract("text", r"(?m)^#{1,6}\s+(?!page)(.*)$", 1))
    name = F.concat(T.padded(F.col("k") + 1), F.when(title != "", F.concat(F.lit(" - "), title)).otherwise(""), F.lit(".md"))
    return parts.select("doc", name.alias("name"), "text").join(existing.select("doc", "name"), ["doc", "name"], "left_anti")


def sliced(lines: DataFrame) -> DataFrame:
    """doc, text: drafts with timings and folders taken out of their tokens."""
    clip, image = r"\{\s*([^{}@]+?)\s*@\s*[\d.]+\s*-\s*[\d.]+\s*\}", r"(?i)\{\s*(?:[^{}@]*/)?([^{}@/]+?\.(?:jpe?g|png|gif|webp|svg))\s*\}"
    raw = F.regexp_replace(F.regexp_replace("raw", clip, r"{$1}"), image, r"{$1}")
    return lines.withColumn("raw", raw).groupBy("doc").agg(F.array_join(F.sort_array(F.collect_list(F.struct("ln", "raw")))["raw"], "\n").alias("text"))


def utterance_texts(utterances: DataFrame, keys: list[str]) -> DataFrame:
    """keys, txt, json of utterances: a line each, and the list."""
    rows = F.sort_array(F.collect_list(F.struct("utterance", "start", "end", "text")))
    return utterances.groupBy(*keys).agg(F.array_join(rows["text"], "\n").alias("txt"), F.to_json(rows).alias("json"))


def updated_manifest(segments: DataFrame, done: DataFrame, path: str | None = None, text: str = "en", target: str = "ru") -> DataFrame:
    """A manifest's segments with the translations that there are now, other fields as they were (K07). With ``path`` the
    new version is written there: a manifest is never changed under its readers."""
    new = done.select(F.col("en").alias(text), F.col("other").alias("__new"))
    out = segments.join(new, text, "left").withColumn(target, F.coalesce(F.nullif("__new", F.lit("")), target)).select(*segments.columns)
    if path:
        out.write.mode("errorifexists").parquet(path)
    return out
