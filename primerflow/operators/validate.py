"""Checks outside the linter: converter output, clips, subtitles, keyword scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import assets
from .lint import lint
from .module import lines

c = F.col


def module_warnings(docs: DataFrame) -> DataFrame:
    """doc, warning of converted modules, whole documents by pattern and blocks one by one."""
    t = F.coalesce("text", F.lit(""))
    absent = {"module": r"(?m)^\s*\$MODULE", "doc-id": r"(?m)^\s*DIOCO_DOC_ID:\s*\S+", "title": r"(?m)^\$MODULE\s+\S", "target-lang": r"(?m)^\s*TARGET_LANG_G:\s*\S+", "home-lang": r"(?m)^\s*HOME_LANG_G:\s*\S+"}
    present = {"colon": r"(?m)^\s*\$(LESSON|DIALOGUE|GRAMMAR|SELECT|PRODUCE|CHAT)\s*:", "exercise": r"(?m)^\s*\$EXERCISE\b", "translations": r"(?m)^\s*(LINE_T|PROMPT_T|RESPONSE_T|VOCAB_T|FEEDBACK_T):"}
    blocks = F.split(t, r"(?m)^\$")
    lacks = lambda name, field: F.filter(blocks, lambda b: b.startswith(name) & ~b.rlike(rf"(?m)^\s*{field}:"))
    labels = F.transform(F.regexp_extract_all(t, F.lit(r"(?m)^\s*VOICE_SPEAKER:\s*([^=\n]+?)\s*=\s*[^\s|]+\b"), 1), F.trim)
    spellings = F.size(F.array_distinct(labels)) > F.size(F.array_distinct(F.transform(labels, F.lower)))
    found = [
        *[F.when(~t.rlike(p), F.lit(f"missing-{k}")) for k, p in absent.items()], *[F.when(t.rlike(p), F.lit(k)) for k, p in present.items()],
        F.when(F.exists(labels, lambda x: x.rlike(r"\s")), "label-spaces"), F.when(spellings, "label-case"),
    ]
    many = F.concat(F.transform(lacks("SELECT", "ANSWER"), lambda _: F.lit("select-without-answer")), F.transform(lacks("PRODUCE", "RESPONSE"), lambda _: F.lit("produce-without-response")))
    return docs.select("doc", F.explode(F.concat(F.array_compact(F.array(*found)), many)).alias("warning"))


def clip_faults(clips: DataFrame) -> DataFrame:
    """clips (name, start, end, parsed, source_exists) with the reason not to cut them, null if none."""
    return clips.withColumn("fault", F.when(~(c("end") > c("start")), "empty").when(~c("parsed"), "name").when(~c("source_exists"), "source"))


def subtitle_faults(subs: DataFrame, key: str = "tape") -> DataFrame:
    """key, pos, fault of subtitles (begin, end, text in order): order, overlap with the one before, empty text."""
    before = F.lag("begin").over(Window.partitionBy(key).orderBy("pos"))
    fault = F.when(~(c("begin") < c("end")), "order").when(before > c("begin"), "not monotonic").when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty")
    return subs.withColumn("fault", fault).where("fault IS NOT NULL").select(key, "pos", "fault")


def keyword_scores(answers: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """keys, correct, total: answers that hold all of ``must`` and none of ``must_not``."""
    text = F.lower(F.coalesce("text", F.lit("")))
    ok = (text != "") & F.forall("must", lambda w: text.contains(w)) & ~F.exists("must_not", lambda w: text.contains(w))
    return truth.join(answers, [*keys, "panel"], "left").groupBy(*keys).agg(F.count_if(ok).alias("correct"), F.count("*").alias("total"))


def mean_latency(runs: DataFrame) -> DataFrame:
    """model, seconds: mean over the successful runs, 0 without any."""
    return runs.groupBy("model").agg(F.coalesce(F.avg(F.when(c("ok"), c("seconds"))), F.lit(0.0)).alias("seconds"))


def slice_faults(docs: DataFrame, existing: DataFrame) -> DataFrame:
    """doc, fault, n of sliced modules: no title, no language, a timing that was not cut, files that aren't there (n of them)."""
    t = F.coalesce("text", F.lit(""))
    rules = [
        (~t.rlike(r"(?m)^\$MODULE\s+\S"), "missing-title"), (~t.rlike("(?m)^TARGET_LANG_G:"), "missing-target-lang"),
        (~t.rlike("(?m)^HOME_LANG_G:"), "missing-home-lang"), (t.rlike(r"\{[^{}]*@[\d.]"), "leftover-timing"),
    ]
    found = docs.select("doc", F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in rules]))).alias("fault"), F.lit(1).cast("long").alias("n"))
    missing = assets.missing_counts(assets.file_tokens(docs), existing).select("doc", F.lit("missing-files").alias("fault"), "n")
    return found.unionByName(missing)


def staging_faults(docs: DataFrame, sources: DataFrame, existing: DataFrame) -> DataFrame:
    """doc, gate, n: what keeps modules from being staged: diagnostics (all but a missing document id), clip lines that no
    source module has, and files that aren't there, each counted once. A module without a row passes."""
    faults = lint(docs).where("code <> 'missing-dioco-doc-id'").select("doc", F.lit("lint").alias("gate"))
    drift = assets.unknown_clip_lines(lines(docs), lines(sources)).select("doc", F.lit("clip-text").alias("gate"))
    lost = assets.file_tokens(docs).distinct().join(existing.select("name"), "name", "left_anti").select("doc", F.lit("files").alias("gate"))
    return faults.unionByName(drift).unionByName(lost).groupBy("doc", "gate").agg(F.count("*").alias("n"))


def run_counters(rows: DataFrame, *keys: str, state: str = "state") -> DataFrame:
    """keys, total, success, error, skipped, processed of a run's rows, by their ``state`` (A10)."""
    each = [F.count_if(c(state) == s).alias(s) for s in ("success", "error", "skipped")]
    return rows.groupBy(*keys).agg(F.count("*").alias("total"), *each, F.count_if(c(state).isin("success", "error", "skipped")).alias("processed"))


def report(rows: DataFrame, keys: list[str], order: Column, size: int = 20, text: str | None = None, length: int = 80) -> DataFrame:
    """The first ``size`` rows of each key, a long text cut to ``length`` characters for the page."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    out = rows.withColumn("place", first).where(c("place") <= size)
    return out.withColumn(text, F.substring(text, 1, length)) if text else out
