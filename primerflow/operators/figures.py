"""Figures of a lesson: images of segments, labels, display mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def linked_images(segments: DataFrame, images: DataFrame, figures: DataFrame) -> DataFrame:
    """segments with the image of their item; figures without a script are left out (J03, J04). Of images with one index the last counts."""
    last = images.groupBy("fig", "idx").agg(F.max_by("path", "pos").alias("image"))
    return segments.join(figures.select("fig"), "fig").join(last, (segments["fig"] == last["fig"]) & (segments["item_number"] == last["idx"]), "left").select(segments["*"], "image")


def with_boxes(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """images with their box if it has four numbers."""
    good = boxes.where(F.size("box") == 4)
    return images.join(good, ["page", "id"], "left")


def raw_blocks(activities: DataFrame, blocks: DataFrame) -> DataFrame:
    """activities with the lines of the block of their id; a title image hides it, as in the original."""
    return activities.join(blocks.select("doc", F.col("activity_id").alias("id"), "start_line", "end_line"), ["doc", "id"], "left")


def at_source(diagnostics: DataFrame, lines: DataFrame) -> DataFrame:
    """diagnostics with the text of their line, clamped into the document (J23). Neither side is broadcast: sizes of lines are
    guessed from those of documents, far too low."""
    ends = lines.groupBy("doc").agg(F.max("ln").alias("n"))
    placed = diagnostics.join(ends.hint("merge"), "doc").withColumn("ln", F.least(F.greatest("line", F.lit(1)), "n")).drop("n")
    return placed.join(lines.select("doc", "ln", "raw").hint("merge"), ["doc", "ln"], "left")


def token_times(tokens: Column, words: Column, start: Column, end: Column) -> Column:
    """start of each token: its word's if the counts agree, else evenly spaced."""
    n = F.size(tokens)
    return F.when(n == F.size(words), words).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda k: start + k * (end - start) / n))


def effective_activity(images: Column, activity: Column) -> Column:
    """Images make any activity one of vocabulary."""
    return F.when(images > 0, "repeat_vocab").otherwise(F.coalesce(F.nullif(activity, F.lit("")), F.lit("other")))


def display_mode(images: Column, activity: Column) -> Column:
    return F.when(effective_activity(images, activity).isin("listen_circle", "dictation"), "listen").otherwise("readAlong")


def lesson_code(file: Column, title: Column, ordinal: Column, story: bool) -> Column:
    """The code in a file's name; for stories S and the number that the title starts with, else the place (P50)."""
    if story:
        return F.concat(F.lit("S"), F.coalesce(F.nullif(F.regexp_extract(title, r"^(\d+[A-Za-z]?)", 1), F.lit("")), ordinal.cast("string")))
    return F.upper(F.regexp_extract(file, r"(\d+[A-Za-z])", 1))


def public_path(path: Column, file: Column) -> Column:
    """A path if there is one, else images/ and the file's own name."""
    return F.coalesce(F.nullif(path, F.lit("")), F.concat(F.lit("images/"), F.regexp_extract(file, r"([^/]+)$", 1)))


def by_page(refs: DataFrame) -> DataFrame:
    """page, n, idx, panels, caption of image references, a row a page."""
    return refs.groupBy("page").agg(F.count("*").alias("n"), F.max("idx").alias("idx"), F.sum("panel").alias("panels"), F.min("caption").alias("caption"))


def pages_with_images(refs: DataFrame, *keys: str) -> DataFrame:
    """The distinct pages that have images."""
    return refs.select(*keys).distinct()


def neighbours(pages: DataFrame, keys: list[str], page: str) -> DataFrame:
    """pages with the one before and the one after in their book."""
    w = Window.partitionBy(*keys).orderBy(page)
    return pages.withColumn("before", F.lag(page).over(w)).withColumn("after", F.lead(page).over(w))
