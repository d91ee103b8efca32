"""Repository lists and their status, books by lesson, and retry schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def sections(mine: DataFrame, official: DataFrame, community: DataFrame, owner: str) -> DataFrame:
    """section, full_name, name: a repository shows once, in the first list that has it."""
    rest = official.join(mine.select("full_name"), "full_name", "left_anti")
    others = community.where(F.col("owner") != owner).join(mine.select("full_name"), "full_name", "left_anti").join(rest.select("full_name"), "full_name", "left_anti")
    parts = [d.select(F.lit(s).alias("section"), "full_name", "name") for s, d in (("mine", mine), ("official", rest), ("community", others))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def section_counts(rows: DataFrame) -> DataFrame:
    """section, n; one's own section is there even if empty."""
    own = rows.sparkSession.range(1).select(F.lit("mine").alias("section"))
    counts = rows.groupBy("section").agg(F.count("*").alias("n"))
    return own.join(counts, "section", "full").select("section", F.coalesce("n", F.lit(0)).alias("n"))


def status(cloned: Column, ahead: Column, behind: Column, changed: Column) -> Column:
    """remote, conflict, behind, dirty or clean, in that order."""
    return F.when(~cloned, "remote").when((behind > 0) & changed, "conflict").when(behind > 0, "behind").when(changed | (ahead > 0), "dirty").otherwise("clean")


def lesson_lines(book: DataFrame, heading: str, back_matter: str) -> DataFrame:
    """book, lesson, text: lines by the lesson whose heading came last, across files; none before the first or after the
    back matter starts; a lesson that comes again goes on (W02, A05, P32)."""
    w = Window.partitionBy("book").orderBy("file", "ln").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    code = F.regexp_extract("raw", heading, 1)
    rows = book.withColumn("ended", F.max(F.col("raw").rlike(back_matter)).over(w)).withColumn("lesson", F.last(F.when(F.col("raw").rlike(heading), code), ignorenulls=True).over(w))
    kept = rows.where("NOT ended AND lesson IS NOT NULL")
    text = F.array_join(F.sort_array(F.collect_list(F.struct("file", "ln", "raw")))["raw"], "\n")
    return kept.groupBy("book", "lesson").agg(text.alias("text"), F.count("*").alias("n_lines"))


def retry_schedule(attempts: DataFrame, base: float = 2.0, most: int = 3) -> DataFrame:
    """attempts (attempt from 1) with ``seconds`` to wait before the next: doubling; null after the last."""
    return attempts.withColumn("seconds", F.when(F.col("attempt") < most, base * F.pow(F.lit(2.0), F.col("attempt") - 1)))


def error_kind(message: Column) -> Column:
    """rate, network or other."""
    m = F.lower(message)
    rate = m.contains("429") | m.contains("rate limit") | m.contains("resource_exhausted")
    return F.when(rate, "rate").when(m.rlike("fetch failed|enotfound|econnreset|etimedout|eai_again|socket hang up|network|terminated"), "network").otherwise("other")


def newest(repos: DataFrame, size: int = 50) -> DataFrame:
    """The most recently updated repositories."""
    return repos.orderBy(F.desc("updated_at"), "full_name").limit(size)


def compared(a: Column, b: Column) -> Column:
    """-1, 0 or 1 for versions."""
    x, y = T.version_parts(a), T.version_parts(b)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def repo_rows(raw: DataFrame) -> DataFrame:
    """One service's replies as flat rows (P41): an owner without a display name shows the login, no permission is no push."""
    owner, parent = F.col("owner"), F.col("parent")
    return raw.select(
        "name", "full_name", owner["login"].alias("owner"), F.coalesce(T.or_null(owner["full_name"]), owner["login"]).alias("owner_display"), F.col("fork").alias("is_fork"),
        parent["full_name"].alias("parent_full_name"), F.col("private").alias("is_private"), F.coalesce(F.col("permissions")["push"], F.lit(False)).alias("can_push"), "updated_at",
    )


def prompt_documents(parts: DataFrame, rule: str = "\n\n") -> DataFrame:
    """doc, text: the parts of prompts (doc, place, title, text) in order under their titles; missing ones are skipped."""
    body = F.when(T.or_null(T.trim(F.col("text"))).isNotNull(), F.concat_ws("\n\n", F.concat(F.lit("## "), F.col("title")), F.col("text")))
    rows = F.sort_array(F.collect_list(F.struct("place", body.alias("body"))))["body"]
    return parts.groupBy("doc").agg(F.array_join(F.array_compact(rows), rule).alias("text"))


def sided(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str, str] = ("both", "book", "tape")) -> DataFrame:
    """key, side: keys that both have, and those that only one has (J01, J02, U04). One full join of distinct keys."""
    a, b = left.select(key, F.lit(True).alias("__a")).distinct(), right.select(key, F.lit(True).alias("__b")).distinct()
    side = F.when(F.col("__b").isNull(), names[1]).when(F.col("__a").isNull(), names[2]).otherwise(names[0])
    return a.join(b, key, "full").select(key, side.alias("side"))


def with_local(repos: DataFrame, local: DataFrame, name: str = "name") -> DataFrame:
    """repos with the state of the local copy of their bare name, and whether there is one."""
    return repos.join(local.withColumn("cloned", F.lit(True)), name, "left").withColumn("cloned", F.coalesce("cloned", F.lit(False)))


def lesson_of(manifest: DataFrame, key: str, wanted) -> DataFrame:
    """The first row of a manifest with that key (S17): a filter that reaches the scan, and one row."""
    return manifest.where(F.col(key) == wanted).limit(1)


def in_code_order(rows: DataFrame, code: str) -> DataFrame:
    """Rows in the order of their codes' characters, 10A before 2A."""
    return rows.orderBy(code)


def in_number_order(rows: DataFrame, code: str) -> DataFrame:
    """Rows in the order of the first number of their codes, those without one first, ties by the code."""
    return rows.orderBy(F.regexp_extract(code, r"(\d+)", 1).cast("long"), code)


def places(rows: DataFrame, keys: list[str], code: str) -> DataFrame:
    """rows with their places in the order of codes and in that of numbers, within their keys."""
    own = Window.partitionBy(*keys)
    number = F.regexp_extract(code, r"(\d+)", 1).cast("long")
    return rows.withColumn("by_code", F.row_number().over(own.orderBy(code))).withColumn("by_number", F.row_number().over(own.orderBy(number, code)))
