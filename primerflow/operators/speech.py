"""Timed words: merging, sessions, as-of and interval joins, alignment. Every join has a figure key beside its range."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

FIG = ["lesson", "fig"]


def merge_subwords(tokens: DataFrame, keys: list[str] = FIG) -> DataFrame:
    """keys, word_no, word, start, end of tokens (pos, text, start_ms, end_ms): one with a leading space starts a word;
    tokens of white space only are skipped (W08)."""
    rows = tokens.where(T.trim(F.col("text")) != "")
    order = Window.partitionBy(*keys).orderBy("pos")
    opens = F.when(F.col("text").startswith(" ") | (F.row_number().over(order) == 1), 1).otherwise(0)
    rows = rows.withColumn("opens", opens).withColumn("word_no", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = F.sort_array(F.collect_list(F.struct("pos", "text")))["text"]
    return rows.groupBy(*keys, "word_no").agg(T.trim(F.array_join(parts, "")).alias("word"), (F.min("start_ms") / 1000).alias("start"), (F.max_by("end_ms", "pos") / 1000).alias("end"))


def utterances(words: DataFrame, keys: list[str] = FIG, gap: float = 1.5) -> DataFrame:
    """keys, utterance, start, end, text: words up to a sentence end or a pause longer than ``gap``."""
    order = Window.partitionBy(*keys).orderBy("word_no")
    ended = F.lag("word").over(order).rlike("[.!?]$") | (F.col("start") - F.lag("end").over(order) > gap)
    rows = words.withColumn("breaks", F.when(ended, 1).otherwise(0)).withColumn("utterance", F.sum("breaks").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = F.sort_array(F.collect_list(F.struct("word_no", "word")))["word"]
    return rows.groupBy(*keys, "utterance").agg(F.min_by("start", "word_no").alias("start"), F.max_by("end", "word_no").alias("end"), F.array_join(parts, " ").alias("text"))


def active_segment(points: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """points with ``seg``: the last segment that starts at or before t, null before the first (J14). A union and a
    window: one sort by figure and time instead of a join of ranges."""
    both = segments.select(*keys, F.col("start").alias("t"), "seg", F.lit(0).alias("late"), F.lit(None).cast("long").alias("point")).unionByName(points.select(*keys, "t", F.lit(None).cast("long").alias("seg"), F.lit(1).alias("late"), "point"))
    upto = Window.partitionBy(*keys).orderBy("t", "late", "seg").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("seg", F.last("seg", ignorenulls=True).over(upto)).where("late = 1").select(*keys, "point", "t", "seg")


def overlapping(windows: DataFrame, words: DataFrame, keys: list[str], slack: float = 0.4) -> DataFrame:
    """keys, win, lo, hi: first and last word that overlaps a range with some slack."""
    w, x = words.alias("w"), windows.alias("x")
    near = (F.col("w.end") > F.col("x.start") - slack) & (F.col("w.start") < F.col("x.end") + slack)
    same = [F.col(f"w.{k}") == F.col(f"x.{k}") for k in keys]
    on = near
    for s in same:
        on = on & s
    return x.join(w, on).groupBy(*[F.col(f"x.{k}") for k in keys], "x.win").agg(F.min("w.word_no").alias("lo"), F.max("w.word_no").alias("hi"))


def lit_at(start: Column, end: Column, t: Column, closed: bool = False) -> Column:
    """Whether t is inside [start, end), or [start, end]."""
    return (t >= start) & ((t <= end) if closed else (t < end) & (end > start))


def speech_edges(clips: DataFrame, silences: DataFrame, key: str = "clip") -> DataFrame:
    """key, start, end: a clip's edges moved to the silences around it (A13). Silences are times in the widened window."""
    head, tail, near, pad = 0.6, 0.5, 0.2, 0.04
    ws, we = F.greatest(F.lit(0.0), F.col("start") - head), F.col("end") + tail
    rows = clips.withColumn("ws", ws).withColumn("we", we).join(silences, key, "left")
    a_start, a_end = F.col("start") - F.col("ws"), F.col("end") - F.col("ws")
    onset = F.max(F.when((F.col("kind") == "end") & (F.col("t") <= a_start + near), F.col("t")))
    offset = F.min(F.when((F.col("kind") == "start") & (F.col("t") > a_end - 0.05), F.col("t")))
    out = rows.groupBy(key, "start", "end", "ws", "we").agg(onset.alias("onset"), offset.alias("offset"))
    ns = F.col("ws") + F.coalesce("onset", F.greatest(F.lit(0.0), a_start - 0.35)) - pad
    ne = F.col("ws") + F.coalesce("offset", F.col("we") - F.col("ws")) + pad
    ok = ne > ns
    return out.select(key, F.greatest(F.lit(0.0), F.when(ok, ns).otherwise(F.greatest(F.lit(0.0), F.col("start") - 0.3))).alias("start"), F.when(ok, ne).otherwise(F.col("end") + 0.3).alias("end"))


def pad_clamp(words: DataFrame, keys: list[str], pad: float = 0.2) -> DataFrame:
    """words with clip_start, clip_end: a start not nearer than ``pad`` to the word before, the end at the word's own
    start, 0.1 at least (W15)."""
    before = F.lag("end").over(Window.partitionBy(*keys).orderBy("word_no"))
    start = F.when(F.col("start") - pad < before, F.least(before + pad, F.col("start") + pad)).otherwise(F.col("start"))
    out = words.withColumn("clip_start", start)
    return out.withColumn("clip_end", F.when(F.col("start") <= F.col("clip_start"), F.col("clip_start") + 0.1).otherwise(F.col("start")))


def fill_gaps(rows: DataFrame, keys: list[str]) -> DataFrame:
    """start and end of unmatched tokens (null) from their neighbours (W17): the first of a gap spans it, further ones
    have no width and stand at its end."""
    order = Window.partitionBy(*keys).orderBy("pos")
    before = F.last("end", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("start", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    first = F.lag("start").over(order).isNotNull() | (F.row_number().over(order) == 1)
    low = F.coalesce(before, after, F.lit(0.0))
    high = F.coalesce(after, low)
    hole = F.col("start").isNull()
    out = rows.withColumns({"__low": low, "__high": high, "__first": first})
    start = F.when(hole, F.when(F.col("__first"), F.col("__low")).otherwise(F.col("__high"))).otherwise(F.col("start"))
    return out.withColumn("end", F.when(hole, F.col("__high")).otherwise(F.col("end"))).withColumn("start", start).drop("__low", "__high", "__first")


def regroup(lines: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line, start, end: a flat run of words (pos from 0) cut back into lines by their counts ``n``."""
    order = Window.partitionBy(*keys).orderBy("line")
    ends = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = lines.withColumn("to", ends).withColumn("from", F.col("to") - F.col("n"))
    # as-of: the line whose first place is the last at or before a word's
    starts = cut.where("n > 0").select(*keys, F.col("from").cast("double").alias("start"), F.col("line").cast("long").alias("seg"))
    points = words.select(*keys, F.col("pos").cast("double").alias("t"), F.col("pos").cast("long").alias("point"))
    placed = active_segment(points, starts, keys).select(*keys, F.col("point").alias("pos"), F.col("seg").alias("line"))
    return placed.join(words.withColumn("pos", F.col("pos").cast("long")), [*keys, "pos"]).groupBy(*keys, "line").agg(F.min_by("start", "pos").alias("start"), F.max_by("end", "pos").alias("end"), F.count("*").alias("n"))


# Phrases that a recording puts before what is asked for.
CUES = [r"^(number|item) (one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty)\b", r"^repeat\b", r"^(and )?the answers? to number \w+ (is|are)\b", r"^listen to the examples?\b", r"^(this is an? )?example\b", r"^listen\b"]


def cue_words(window: Column, line: Column) -> Column:
    """How many words to skip at the start of a window: up to three cues in a row, unless the line itself starts so."""
    patterns = F.filter(F.array(*map(F.lit, CUES)), lambda p: ~F.regexp_like(line, p))

    def skip(state: Column, _: Column) -> Column:
        cue = F.get(F.filter(F.transform(patterns, lambda p: F.regexp_substr(state["rest"], p)), lambda c: c.isNotNull()), F.lit(0))
        rest = F.regexp_replace(F.substring(state["rest"], F.length(cue) + 1, F.length(state["rest"])), "^ ", "")
        n = F.size(F.split(cue, " "))
        return F.when(cue.isNull(), state).otherwise(F.struct((state["n"] + n).alias("n"), rest.alias("rest")))

    return F.aggregate(F.array(F.lit(1), F.lit(2), F.lit(3)), F.struct(F.lit(0).alias("n"), window.alias("rest")), skip)["n"]


class _Rows:
    """Rows of the table of longest common subsequences of suffixes, as one whole number each: bit k of row i is 1 if the
    length falls when ``b`` loses the word that is k before its end (``a`` from i on). A row follows from the one
    below by an addition over all words of ``b`` at once."""

    KEEP = 1 << 26

    def __init__(self, a: list[str], b: list[str]):
        self.a, self.size, self.full = a, len(b), (1 << len(b)) - 1
        self.places: dict[str, list[int]] = {}
        for k, w in enumerate(reversed(b)):
            self.places.setdefault(w, []).append(k)
        self.known: dict[str, int] = {}
        self.room = self.KEEP

    def mask(self, word: str) -> int:
        """The places of a word in ``b``; those of frequent words are kept, up to ``KEEP`` bytes of them."""
        at = self.places.get(word)
        if at is None:
            return 0
        if len(at) < 8:
            return sum(1 << k for k in at)
        if word not in self.known:
            flags = np.zeros(self.size, np.uint8)
            flags[at] = 1
            found = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
            self.room -= self.size // 8
            if self.room < 0:
                return found
            self.known[word] = found
        return self.known[word]

    def above(self, i: int, below: int) -> int:
        """Row i by row i + 1."""
        rest = self.full ^ below
        hit = rest & self.mask(self.a[i])
        return self.full & ~((rest + hit) | (rest - hit))


def lcs_pairs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, from the start; where both ways are as good, ``a`` advances.

    A row takes an eighth of a byte a word of ``b``. About the square root of the rows is held: every ``step``-th is kept,
    and the rows between two of them are made again when the way comes to them."""
    table, step = _Rows(a, b), max(1, isqrt(len(a)))
    row, kept = 0, {len(a): 0}
    for i in range(len(a) - 1, -1, -1):
        row = table.above(i, row)
        if i % step == 0:
            kept[i] = row
    i, j, out = 0, 0, []
    length = lambda r, j: (r & ((1 << (len(b) - j)) - 1)).bit_count()
    while i < len(a) and j < len(b):
        first, last = i, min(i + step, len(a))
        rows = [kept[last]]
        for k in range(last - 1, first - 1, -1):
            rows.append(table.above(k, rows[-1]))
        rows.reverse()
        here, below = length(rows[0], j), length(rows[1], j)
        while i < last and j < len(b):
            if a[i] == b[j]:
                out.append((i, j))
                i, j = i + 1, j + 1
            elif below == here:  # as long without this word of a
                i += 1
                if i < last:
                    here, below = below, length(rows[i + 1 - first], j)
                continue
            else:
                at = len(b) - j - 1
                here, below = here - (rows[i - first] >> at & 1), below - (rows[i + 1 - first] >> at & 1)
                j += 1
                continue
            if i < last:
                here, below = length(rows[i - first], j), length(rows[i + 1 - first], j)
    return out


def align(rows: DataFrame, key: str = "id") -> DataFrame:
    """key, n_pairs, first_a, last_a, first_b, last_b, score, coverage of token arrays ``a`` and ``b``."""
    names = [key, "n_pairs", "first_a", "last_a", "first_b", "last_b", "score", "coverage"]
    kinds = [pa.int64(), *[pa.int32()] * 5, pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, a, b in zip(*(batch.column(n).to_pylist() for n in range(3))):
                p = lcs_pairs(a or [], b or [])
                ends = (p[0][0], p[-1][0], p[0][1], p[-1][1]) if p else (None,) * 4
                out.append((k, len(p), *ends, len(p) / len(a) if a else 0.0, (ends[3] - ends[2] + 1) / len(b) if p else 0.0))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, kinds)], names)

    return rows.select(key, "a", "b").mapInArrow(run, f"{key} long, n_pairs int, first_a int, last_a int, first_b int, last_b int, score double, coverage double")


def chosen_span(aligned: DataFrame) -> DataFrame:
    """span: ``match`` where the matched words cover most of the window, ``segment`` where a fully matched line is
    narrower, else ``window`` (W27)."""
    return aligned.withColumn("span", F.when(F.col("n_pairs") == 0, F.lit(None)).when(F.col("coverage") >= 0.7, "match").when(F.col("score") >= 0.999, "segment").otherwise("window"))


def segment_span(words: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """keys, a, b: all words of the window whose segment lies between those of its matched words (W16). ``words`` has
    word_no, seg, and on each row the matched range lo..hi."""
    seg = lambda c: F.max(F.when(F.col("word_no") == F.col(c), F.col("seg"))).over(Window.partitionBy(*keys))
    rows = words.withColumns({"s_lo": seg(lo), "s_hi": seg(hi)}).where("seg BETWEEN s_lo AND s_hi")
    return rows.groupBy(*keys).agg(F.min("word_no").alias("a"), F.max("word_no").alias("b"))
