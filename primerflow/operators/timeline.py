"""Timeline arithmetic over typed items and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Seconds of the parts of a segment.
TITLE, PRE_ROLL, PER_WORD, AFTER_LINE, REPEAT_GAP = 4.5, 0.8, 1.4, 1.0, 0.6
THINK, REVEAL_GAP, FEEDBACK_MIN, AFTER_REVEAL, PRODUCE_THINK, PRODUCE_TAIL, EXAMPLE_THINK = 3.2, 0.4, 2.4, 1.4, 2.6, 1.2, 0.9


def intro_seconds(intro: Column, instruction: Column) -> Column:
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    return T.clamp(4.0, 2.5 + (size(intro) + size(instruction)) * 0.05, 13.0)


def dialogue_cues(text: Column, clip: Column, vocab: Column, repeat: Column) -> Column:
    """struct(clip_at, repeat_at, duration) of a dialogue line; ``clip`` is its clip's seconds or null, ``vocab`` a count."""
    at = PRE_ROLL + vocab * PER_WORD
    body = F.coalesce(clip, T.read_seconds(text))
    again = at + body + REPEAT_GAP
    return F.struct(at.alias("clip_at"), F.when(repeat, again).alias("repeat_at"), F.when(repeat, again + body + 0.5).otherwise(at + body + AFTER_LINE).alias("duration"))


def select_cues(shown: Column, clip: Column, example: Column, answer_clip: Column, feedback: Column) -> Column:
    """struct(clip_at, reveal_at, answer_clip_at, duration) of a SELECT item; ``shown`` is its prompt or template."""
    reveal = PRE_ROLL + F.coalesce(clip, T.read_seconds(shown)) + F.when(example, EXAMPLE_THINK).otherwise(THINK)
    answer = F.coalesce(answer_clip, F.lit(0.0))
    tail = F.when(T.or_null(feedback).isNotNull(), F.greatest(F.lit(FEEDBACK_MIN), T.read_seconds(feedback))).otherwise(AFTER_REVEAL)
    return F.struct(F.lit(PRE_ROLL).alias("clip_at"), reveal.alias("reveal_at"), F.when(answer > 0, reveal + REVEAL_GAP).alias("answer_clip_at"), (reveal + REVEAL_GAP + answer + tail).alias("duration"))


def produce_cues(prompt: Column, template: Column, clip: Column, example: Column, response: Column, response_clip: Column) -> Column:
    """struct(clip_at, reveal_at, response_at, duration) of a PRODUCE item."""
    at = PRE_ROLL + F.when(T.or_null(template).isNotNull(), T.read_seconds(template)).otherwise(0.0)
    body = F.coalesce(clip, T.read_seconds(F.coalesce(T.or_null(prompt), template, F.lit(""))))
    think = F.when(example, EXAMPLE_THINK).otherwise(F.greatest(F.lit(PRODUCE_THINK), F.coalesce(response_clip, F.lit(0.0))))
    reveal = at + body + think
    said = F.when(response.isNotNull(), F.coalesce(response_clip, T.read_seconds(response))).otherwise(0.0)
    return F.struct(at.alias("clip_at"), reveal.alias("reveal_at"), F.when(response.isNotNull(), reveal + REVEAL_GAP).alias("response_at"), (reveal + REVEAL_GAP + said + PRODUCE_TAIL).alias("duration"))


def audio_only(show_prompt: Column, audio: Column) -> Column:
    """A prompt is hidden unless it is to be shown, where a clip carries it."""
    return ~show_prompt & audio.isNotNull()


def frames(seconds: Column, fps: int = 30) -> Column:
    """At least one frame, rounded."""
    return F.greatest(F.lit(1).cast("long"), F.floor(seconds * fps + 0.5))


def offsets(segments: DataFrame, keys: list[str], order: str) -> DataFrame:
    """segments with ``at``: the sum of the frames before."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("at", F.coalesce(F.sum("frames").over(before), F.lit(0)))


def islands(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, value, first, last of runs of equal values; rows without a value break nothing."""
    known = rows.where(F.col(value).isNotNull())
    w = Window.partitionBy(*keys).orderBy(order)
    change = F.when(F.col(value) != F.lag(value).over(w), 1).otherwise(0)
    run = F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = known.withColumn("__c", change).withColumn("__r", run)
    return out.groupBy(*keys, "__r", value).agg(F.min(order).alias("first"), F.max(order).alias("last")).drop("__r")


def current_image(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows with ``shown``: the latest image, forgotten at an instruction, whose own image counts."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = rows.withColumn("__part", F.sum(F.when(F.col("role") == "instruction", 1).otherwise(0)).over(w))
    inside = Window.partitionBy(*keys, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return part.withColumn("shown", F.last("image", ignorenulls=True).over(inside)).drop("__part")


def repeat_pauses(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, order, pause_from, pause_to of the pauses after segments other than instructions; open after the last."""
    nxt = F.lead("start").over(Window.partitionBy(*keys).orderBy(order))
    out = rows.withColumn("next", nxt).where("role <> 'instruction' AND (next IS NULL OR next - end > 1.2)")
    return out.select(*keys, order, (F.col("end") + 0.5).alias("pause_from"), (F.col("next") - 0.2).alias("pause_to"))


def caption(role: Column, listen: Column, end: Column, t: Column) -> Column:
    """struct(show, revealed): instructions never show; a stimulus to listen to shows at its end."""
    late = t >= end - 0.05
    hidden = listen & role.isin("prompt", "letters", "numbers")
    return F.struct(F.when(role == "instruction", False).when(hidden, late).otherwise(True).alias("show"), F.when(hidden & (role != "instruction"), late).otherwise(True).alias("revealed"))


def progress(t: Column, start: Column, seconds: Column) -> Column:
    """How much of a part has passed, from 0 to 1."""
    return T.clamp(0.0, (t - start) / F.greatest(F.lit(0.001), seconds), 1.0)


def spread(start: Column, end: Column, place: Column, n: Column) -> Column:
    """Start of the place-th of n parts of equal length."""
    return start + place * (end - start) / n


def chunks(rows: DataFrame, number: str, size: int) -> DataFrame:
    """chunk, first, last of numbers from 1 in chunks of a size."""
    return rows.groupBy(F.floor((F.col(number) - 1) / size).alias("chunk")).agg(F.min(number).alias("first"), F.max(number).alias("last"))


def batched(rows: DataFrame, keys: list[str], order: str, size: int = 40) -> DataFrame:
    """rows with ``batch``: calls of up to ``size`` rows each, in order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("batch", F.floor((n - 1) / size))


def playable(activities: DataFrame) -> DataFrame:
    """Activities that have a place on the timeline: notes and chats have none."""
    return activities.where(~F.col("type").isin("GRAMMAR", "CHAT"))
