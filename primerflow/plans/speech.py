"""Queries over timed words and timelines, made of events: a user is a figure, hours are seconds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import speech as S
from ..operators import timeline as L
from . import render as R


def _events(spark, d):
    e = R.table(spark, d, "events")
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") / 3.6e9
    word = F.concat("event_type", F.when(F.col("event_id") % 5 == 0, ".").otherwise(""))
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.lit("1A").alias("lesson"), F.col("user_id").alias("fig"), number.alias("word_no"), word.alias("word"), start.alias("start"), (start + F.col("value") / 100).alias("end"), "event_type", "event_id", "value")


def subword_words(spark, d):
    """Words cut into pieces of three characters and merged again, with their times."""
    # dealt by document before texts become words and pieces, so that only texts are shuffled
    texts = R.table(spark, d, "documents").select("doc_id", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    docs = texts.select("doc_id", F.posexplode(F.split(T.squeeze(F.col("text")), " ")).alias("w", "word")).where("word <> ''")
    pieces = F.regexp_extract_all("word", F.lit(r"(.{1,3})"), 1)
    tokens = docs.select("doc_id", "w", F.posexplode(pieces).alias("p", "piece"))
    at = F.col("w") * 1000 + F.col("p") * 10
    tokens = tokens.select(F.col("doc_id").alias("fig"), at.alias("pos"), F.when(F.col("p") == 0, F.concat(F.lit(" "), F.col("piece"))).otherwise(F.col("piece")).alias("text"), at.alias("start_ms"), (at + 5).alias("end_ms"))
    out = S.merge_subwords(tokens, ["fig"])
    return out.groupBy("fig").agg(F.count("*").alias("n_words"), F.max(F.length("word")).alias("longest"), F.sum(T.nearest((F.col("end") - F.col("start")) * 1000).cast("long")).alias("ms"))


def utterances(spark, d):
    out = S.utterances(_events(spark, d))
    return out.select("fig", F.col("utterance").cast("int").alias("utterance"), T.nearest(F.col("start"), 3).alias("start"), T.nearest(F.col("end"), 3).alias("end"), "text")


def active_segments(spark, d):
    """For each error, the last purchase of the same user that started before it or with it."""
    e = _events(spark, d)
    points = e.where("event_type = 'error'").select("fig", F.col("start").alias("t"), F.col("event_id").alias("point"))
    segments = e.where("event_type = 'purchase'").select("fig", "start", F.col("event_id").alias("seg"))
    return S.active_segment(points, segments, ["fig"]).select("fig", "point", "seg")


def overlapping_words(spark, d):
    e = _events(spark, d)
    windows = e.select("fig", F.col("event_id").alias("win"), "start", (F.col("end") + 5).alias("end"))
    return S.overlapping(windows, e, ["fig"])


def lit_words(spark, d):
    """Words lit at the quarter of their time, and at their end."""
    e = _events(spark, d)
    at = lambda share: F.col("start") + (F.col("end") - F.col("start")) * share
    inside, last = S.lit_at(F.col("start"), F.col("end"), at(0.25)), S.lit_at(F.col("start"), F.col("end"), F.col("end"), closed=True)
    return e.groupBy("event_type").agg(F.count_if(inside).alias("inside"), F.count_if(last).alias("closed"))


def speech_edges(spark, d):
    e = R.table(spark, d, "events")
    clips = e.select(F.col("event_id").alias("clip"), F.col("value").alias("start"), (F.col("value") + 1).alias("end"))
    part = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("t")) for k, v in (("end", 0.25), ("end", 0.75), ("start", 1.5), ("start", 1.75))]))
    silences = clips.where("clip % 3 <> 0").select("clip", part.alias("s")).select("clip", "s.*")
    out = S.speech_edges(clips, silences)
    return out.select("clip", T.nearest(F.col("start"), 2).alias("start"), T.nearest(F.col("end"), 2).alias("end"))


def pad_clamp(spark, d):
    out = S.pad_clamp(_events(spark, d), ["fig"])
    return out.select("event_id", T.nearest(F.col("clip_start"), 3).alias("clip_start"), T.nearest(F.col("clip_end"), 3).alias("clip_end"))


def filled_gaps(spark, d):
    """Every third event loses its times and gets those of its neighbours."""
    e = _events(spark, d)
    hole = F.col("word_no") % 3 == 0
    rows = e.select("fig", F.col("word_no").alias("pos"), F.when(~hole, F.col("start")).alias("start"), F.when(~hole, F.col("end")).alias("end"))
    out = S.fill_gaps(rows, ["fig"])
    return out.select("fig", "pos", T.nearest(F.col("start"), 3).alias("start"), T.nearest(F.col("end"), 3).alias("end"))


def regrouped(spark, d):
    """Words of each user cut into lines of four."""
    e = _events(spark, d).withColumn("pos", F.col("word_no") - 1)
    lines = e.groupBy("fig", F.floor(F.col("pos") / 4).cast("int").alias("line")).agg(F.count("*").alias("n"))
    out = S.regroup(lines, e.select("fig", "pos", "start", "end"), ["fig"])
    return out.select("fig", "line", "n", T.nearest(F.col("start"), 3).alias("start"), T.nearest(F.col("end"), 3).alias("end"))


def segment_spans(spark, d):
    """The span of words whose segment (of five words) lies between those of the words 7 and 13."""
    e = _events(spark, d).select("fig", "word_no", F.floor((F.col("word_no") - 1) / 5).alias("seg"), F.lit(7).alias("lo"), F.lit(13).alias("hi"))
    return S.segment_span(e, ["fig"])


def cue_words(spark, d):
    """Words that cues take up in front of part names."""
    lead = F.element_at(F.array(*map(F.lit, ("", "number two ", "repeat ", "and the answer to number six is ", "listen to the example number one "))), (F.col("p_partkey") % 5 + 1).cast("int"))
    n = S.cue_words(F.concat(lead, F.col("p_name")), F.col("p_name"))
    return R.table(spark, d, "part").select("p_partkey", n.alias("n"))


def aligned(spark, d):
    """Each document's words against themselves without every fifth."""
    words = F.filter(F.transform(F.split(T.squeeze(F.col("text")), " "), T.token_key), lambda w: w != "")
    docs = R.table(spark, d, "documents").select(F.col("doc_id").alias("id"), words.alias("a"))
    return S.chosen_span(S.align(docs.withColumn("b", F.filter("a", lambda w, k: k % 5 != 4))))


def _segments(spark, d):
    return _events(spark, d).withColumn("role", F.when(F.col("event_type") == "signup", "instruction").otherwise("prompt"))


def timeline_offsets(spark, d):
    out = L.offsets(_events(spark, d).withColumn("frames", L.frames(F.col("value"))), ["fig"], "word_no")
    return out.select("event_id", "frames", F.col("at").cast("long").alias("begins"))


def frame_totals(spark, d):
    return _events(spark, d).groupBy("fig").agg(F.sum(L.frames(F.col("value"))).alias("frames"))


def islands(spark, d):
    rows = _events(spark, d).withColumn("kind", F.when(F.col("event_type") != "error", F.col("event_type")))
    return L.islands(rows, ["fig"], "word_no", "kind")


def current_images(spark, d):
    rows = _segments(spark, d).withColumn("image", F.when(F.col("event_type") == "purchase", F.concat(F.lit("i"), F.col("event_id").cast("string"))))
    return L.current_image(rows, ["fig"], "word_no").select("event_id", "shown")


def repeat_pauses(spark, d):
    out = L.repeat_pauses(_segments(spark, d), ["fig"], "word_no")
    return out.select("fig", "word_no", T.nearest(F.col("pause_from"), 3).alias("pause_from"), T.nearest(F.col("pause_to"), 3).alias("pause_to"))


def captions(spark, d):
    rows = _segments(spark, d)
    t = F.col("start") + F.when(F.col("event_id") % 2 == 0, 0.0).otherwise(100.0)
    state = L.caption(F.col("role"), F.col("fig") % 2 == 0, F.col("end"), t)
    return rows.select("event_id", state["show"].alias("show"), state["revealed"].alias("revealed"))


def spread_starts(spark, d):
    """Three parts of each event's time, and how far its first half second is."""
    rows = _events(spark, d).select("event_id", "start", "end", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("place"))
    at = L.spread(F.lit(0.0), F.col("end") - F.col("start"), F.col("place"), F.lit(3))
    return rows.select("event_id", "place", T.nearest(at, 4).alias("begins"), T.nearest(L.progress(F.lit(0.5), F.lit(0.0), F.col("end") - F.col("start")), 3).alias("progress"))


def dialogue_cues(spark, d):
    e = R.table(spark, d, "events")
    cues = L.dialogue_cues(F.repeat(F.lit("word "), (F.col("event_id") % 30).cast("int")), F.when(F.col("event_id") % 2 == 0, F.col("value")), (F.col("event_id") % 3).cast("int"), F.col("event_type") == "click")
    rows = e.withColumn("c", cues)
    return rows.select("event_id", *[T.nearest(F.col(f"c.{n}"), 3).alias(n) for n in ("clip_at", "repeat_at", "duration")])


def select_cues(spark, d):
    e = R.table(spark, d, "events")
    cues = L.select_cues(F.repeat(F.lit("word "), (F.col("event_id") % 30).cast("int")), F.when(F.col("event_id") % 2 == 0, F.col("value")), F.col("event_type") == "view", F.when(F.col("event_id") % 3 == 0, F.lit(2.5)), F.when(F.col("event_id") % 4 == 0, F.repeat(F.lit("well done "), 5)))
    rows = e.withColumn("c", cues)
    return rows.select("event_id", *[T.nearest(F.col(f"c.{n}"), 3).alias(n) for n in ("reveal_at", "answer_clip_at", "duration")])


def produce_cues(spark, d):
    e = R.table(spark, d, "events")
    n = (F.col("event_id") % 30).cast("int")
    cues = L.produce_cues(F.repeat(F.lit("word "), n), F.when(n < 10, F.lit("a b c d")), F.when(F.col("event_id") % 2 == 0, F.col("value")), F.col("event_type") == "view", F.when(F.col("event_id") % 7 != 0, F.lit("one two three four five")), F.when(F.col("event_id") % 3 == 0, F.lit(3.5)))
    rows = e.withColumn("c", cues)
    return rows.select("event_id", *[T.nearest(F.col(f"c.{n}"), 3).alias(n) for n in ("clip_at", "reveal_at", "response_at", "duration")])


def event_chunks(spark, d):
    return L.chunks(R.table(spark, d, "events").select((F.col("event_id") + 1).alias("n")), "n", 6)


_E = """
e AS (SELECT user_id AS fig, event_id, event_type, value, epoch_us(ts) / 3.6e9 AS s, epoch_us(ts) / 3.6e9 + value / 100 AS t,
  event_type || CASE WHEN event_id % 5 = 0 THEN '.' ELSE '' END AS word, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS word_no FROM events)
"""
_r = lambda x, k=1000: f"floor(({x}) * {k} + 0.5) / {k}"
_READ = lambda n: f"greatest(2.2, least(1.2 + ({n}) * 0.32, 8.0))"
SQL = {
    "subword_words": r"""
WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) AS word FROM documents),
x AS (SELECT doc_id, length(word) AS n FROM w WHERE word <> '')
SELECT doc_id AS fig, count(*) AS n_words, CAST(max(n) AS INT) AS longest, CAST(sum(CAST((CAST(ceil(n / 3.0) AS BIGINT) - 1) * 10 + 5 AS BIGINT)) AS BIGINT) AS ms FROM x GROUP BY ALL""",
    "utterances": f"""
WITH {_E}, b AS (SELECT *, CASE WHEN lag(word) OVER w LIKE '%.' OR s - lag(t) OVER w > 1.5 THEN 1 ELSE 0 END AS brk FROM e WINDOW w AS (PARTITION BY fig ORDER BY word_no)),
u AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY fig ORDER BY word_no) AS INT) AS utterance FROM b)
SELECT fig, utterance, {_r("arg_min(s, word_no)")} AS start, {_r("arg_max(t, word_no)")} AS "end", string_agg(word, ' ' ORDER BY word_no) AS text FROM u GROUP BY fig, utterance""",
    "active_segments": f"WITH {_E}, p AS (SELECT * FROM e WHERE event_type = 'error'), g AS (SELECT * FROM e WHERE event_type = 'purchase') SELECT p.fig, p.event_id AS point, g.event_id AS seg FROM p ASOF LEFT JOIN g ON p.fig = g.fig AND p.s >= g.s",
    "overlapping_words": f"WITH {_E} SELECT x.fig, x.event_id AS win, min(w.word_no) AS lo, max(w.word_no) AS hi FROM e x JOIN e w ON x.fig = w.fig AND w.t > x.s - 0.4 AND w.s < x.t + 5 + 0.4 GROUP BY ALL",
    "lit_words": f"WITH {_E} SELECT event_type, count(*) FILTER (s + (t - s) * 0.25 >= s AND s + (t - s) * 0.25 < t AND t > s) AS inside, count(*) FILTER (t >= s) AS closed FROM e GROUP BY ALL",
    "speech_edges": f"""
WITH c AS (SELECT event_id AS clip, value AS s, value + 1 AS e, greatest(0.0, value - 0.6) AS ws, value + 1.5 AS we FROM events),
q AS (SELECT *, CASE WHEN clip % 3 = 0 THEN NULL WHEN 0.75 <= s - ws + 0.2 THEN 0.75 WHEN 0.25 <= s - ws + 0.2 THEN 0.25 END AS onset,
  CASE WHEN clip % 3 = 0 THEN NULL WHEN 1.5 > e - ws - 0.05 THEN 1.5 WHEN 1.75 > e - ws - 0.05 THEN 1.75 END AS offs FROM c),
n AS (SELECT clip, s, e, ws + coalesce(onset, greatest(0.0, s - ws - 0.35)) - 0.04 AS ns, ws + coalesce(offs, we - ws) + 0.04 AS ne FROM q)
SELECT clip, {_r("greatest(0.0, CASE WHEN ne > ns THEN ns ELSE greatest(0.0, s - 0.3) END)", 100)} AS start, {_r("CASE WHEN ne > ns THEN ne ELSE e + 0.3 END", 100)} AS "end" FROM n""",
    "pad_clamp": f"""
WITH {_E}, p AS (SELECT *, lag(t) OVER (PARTITION BY fig ORDER BY word_no) AS b FROM e),
q AS (SELECT event_id, s, CASE WHEN s - 0.2 < b THEN least(b + 0.2, s + 0.2) ELSE s END AS cs FROM p)
SELECT event_id, {_r("cs")} AS clip_start, {_r("CASE WHEN s <= cs THEN cs + 0.1 ELSE s END")} AS clip_end FROM q""",
    "filled_gaps": f"""
WITH {_E}, p AS (SELECT *, lag(t) OVER w AS b, lead(s) OVER w AS a FROM e WINDOW w AS (PARTITION BY fig ORDER BY word_no))
SELECT fig, word_no AS pos, {_r("CASE WHEN word_no % 3 = 0 THEN b ELSE s END")} AS start, {_r("CASE WHEN word_no % 3 = 0 THEN coalesce(a, b) ELSE t END")} AS "end" FROM p""",
    "regrouped": f'WITH {_E} SELECT fig, CAST((word_no - 1) // 4 AS BIGINT) AS line, count(*) AS n, {_r("arg_min(s, word_no)")} AS start, {_r("arg_max(t, word_no)")} AS "end" FROM e GROUP BY fig, (word_no - 1) // 4',
    "segment_spans": f"WITH {_E} SELECT fig, min(word_no) AS a, max(word_no) AS b FROM e WHERE (word_no - 1) // 5 BETWEEN 1 AND 2 GROUP BY fig ",
    "cue_words": "SELECT p_partkey, CAST([0, 2, 1, 7, 6][p_partkey % 5 + 1] AS INT) AS n FROM part",
    "timeline_offsets": f"WITH {_E}, f AS (SELECT *, CAST(greatest(1, floor(value * 30 + 0.5)) AS BIGINT) AS frames FROM e) SELECT event_id, frames, CAST(coalesce(sum(frames) OVER (PARTITION BY fig ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins FROM f",
    "frame_totals": "SELECT user_id AS fig, CAST(sum(greatest(1, floor(value * 30 + 0.5))) AS BIGINT) AS frames FROM events GROUP BY user_id",
    "islands": f"""
WITH {_E}, k AS (SELECT * FROM e WHERE event_type <> 'error'), c AS (SELECT *, CASE WHEN event_type <> lag(event_type) OVER (PARTITION BY fig ORDER BY word_no) THEN 1 ELSE 0 END AS c FROM k),
r AS (SELECT *, sum(c) OVER (PARTITION BY fig ORDER BY word_no) AS r FROM c)
SELECT fig, event_type AS kind, min(word_no) AS first, max(word_no) AS last FROM r GROUP BY fig, r, event_type""",
    "current_images": f"""
WITH {_E}, p AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY fig ORDER BY word_no) AS part, CASE WHEN event_type = 'purchase' THEN 'i' || event_id END AS img FROM e)
SELECT event_id, last_value(img IGNORE NULLS) OVER (PARTITION BY fig, part ORDER BY word_no) AS shown FROM p""",
    "repeat_pauses": f"""
WITH {_E}, p AS (SELECT *, lead(s) OVER (PARTITION BY fig ORDER BY word_no) AS nxt FROM e)
SELECT fig, word_no, {_r("t + 0.5")} AS pause_from, {_r("nxt - 0.2")} AS pause_to FROM p WHERE event_type <> 'signup' AND (nxt IS NULL OR nxt - t > 1.2)""",
    "captions": f"""
WITH {_E}, p AS (SELECT *, s + CASE WHEN event_id % 2 = 0 THEN 0.0 ELSE 100.0 END >= t - 0.05 AS late FROM e)
SELECT event_id, CASE WHEN event_type = 'signup' THEN false WHEN fig % 2 = 0 THEN late ELSE true END AS show, CASE WHEN event_type <> 'signup' AND fig % 2 = 0 THEN late ELSE true END AS revealed FROM p""",
    "spread_starts": f"WITH {_E} SELECT event_id, CAST(place AS INT) AS place, {_r('0.0 + place * (t - s - 0.0) / 3', 10000)} AS begins, {_r('greatest(0.0, least((0.5 - 0.0) / greatest(0.001, t - s), 1.0))')} AS progress FROM e, (SELECT unnest([0, 1, 2]) AS place)",
    "dialogue_cues": f"""
WITH p AS (SELECT event_id, 0.8 + (event_id % 3) * 1.4 AS c0, coalesce(CASE WHEN event_id % 2 = 0 THEN value END, {_READ("event_id % 30")}) AS body, event_type = 'click' AS rep FROM events)
SELECT event_id, {_r("CAST(c0 AS DOUBLE)")} AS clip_at, CASE WHEN rep THEN {_r("c0 + body + 0.6")} END AS repeat_at, {_r("CASE WHEN rep THEN c0 + body + 0.6 + body + 0.5 ELSE c0 + body + 1.0 END")} AS duration FROM p""",
    "select_cues": f"""
WITH p AS (SELECT event_id, 0.8 + coalesce(CASE WHEN event_id % 2 = 0 THEN value END, {_READ("event_id % 30")}) + CASE WHEN event_type = 'view' THEN 0.9 ELSE 3.2 END AS rv, CASE WHEN event_id % 3 = 0 THEN 2.5 ELSE 0 END AS ans,
  CASE WHEN event_id % 4 = 0 THEN greatest(2.4, {_READ("10")}) ELSE 1.4 END AS tail FROM events)
SELECT event_id, {_r("rv")} AS reveal_at, CASE WHEN ans > 0 THEN {_r("rv + 0.4")} END AS answer_clip_at, {_r("rv + 0.4 + ans + tail")} AS duration FROM p""",
    "produce_cues": f"""
WITH p AS (SELECT *, event_id % 30 AS n, event_id % 7 <> 0 AS has FROM events), q AS (SELECT event_id, has, 0.8 + CASE WHEN n < 10 THEN {_READ("4")} ELSE 0 END AS c0,
  coalesce(CASE WHEN event_id % 2 = 0 THEN value END, CASE WHEN n = 0 THEN {_READ("4")} ELSE {_READ("n")} END) AS body, CASE WHEN event_type = 'view' THEN 0.9 ELSE greatest(2.6, CASE WHEN event_id % 3 = 0 THEN 3.5 ELSE 0 END) END AS think,
  CASE WHEN NOT has THEN 0 WHEN event_id % 3 = 0 THEN 3.5 ELSE {_READ("5")} END AS said FROM p), z AS (SELECT *, c0 + body + think AS rv FROM q)
SELECT event_id, {_r("CAST(c0 AS DOUBLE)")} AS clip_at, {_r("rv")} AS reveal_at, CASE WHEN has THEN {_r("rv + 0.4")} END AS response_at, {_r("rv + 0.4 + said + 1.2")} AS duration FROM z""",
    "event_chunks": "SELECT CAST(event_id // 6 AS BIGINT) AS chunk, min(event_id + 1) AS first, max(event_id + 1) AS last FROM events GROUP BY event_id // 6",
}

QUERIES = {f.__name__: f for f in (subword_words, utterances, active_segments, overlapping_words, lit_words, speech_edges, pad_clamp, filled_gaps, regrouped, segment_spans, cue_words, aligned, timeline_offsets, frame_totals, islands, current_images, repeat_pauses, captions, spread_starts, dialogue_cues, select_cues, produce_cues, event_chunks)}
