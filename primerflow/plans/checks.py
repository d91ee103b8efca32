"""Queries of the linter's rarer rules, validators, orders, nesting and plans over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assets as A
from ..operators import catalog as C
from ..operators import module as M
from ..operators import timeline as L
from ..operators import validate as V
from ..operators.lint import lint
from ..sources import sinks
from ..streaming.lint_stream import gap_sessions as sessions
from . import render as R

s = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")

_H = ["$MODULE Parts", "FORMAT: 2", "DIOCO_DOC_ID: d", "TARGET_LANG_G: fr", "HOME_LANG_G: en"]
_L, _D, _S, _P = ["$LESSON One"], ["$DIALOGUE Talk"], ["$SELECT Pick"], ["$PRODUCE Say"]
#: Modules with a fault each, and the diagnostics (error or warning, line, code) that the format's rules give them.
FAULTS = [
    ([*_H, *_L, *_D, "  LINE: x"], ["e8 field-indent", "w8 raw-content"]),
    ([*_H, *_L, "$DIALOGUE Talk {x.mp3}"], ["w7 title-asset-invalid"]),
    ([*_H, "$LESSON One {x.png}"], ["w6 title-image-unsupported"]),
    ([*_H, *_L, "$FOO bar"], ["w7 section-unknown"]),
    ([*_H, *_D], ["w6 implicit-lesson"]),
    ([*_H, *_L, "REPEAT"], ["w7 repeat-outside-dialogue"]),
    ([*_H, *_L, *_D, "MULTI"], ["w8 flag-outside-select"]),
    ([*_H, *_L, *_D, "SHOW_PROMPT"], ["w8 flag-outside-show-prompt"]),
    ([*_H, *_L, *_D, "AUDIO_ONLY"], ["e8 legacy-audio-only"]),
    ([*_H, *_L, *_D, "EXAMPLE"], ["w8 example-outside-item"]),
    ([*_H, *_L, *_S, "TEMPLATE: a ____ {x.mp3}", "ANSWER: b"], ["w8 template-with-clip"]),
    ([*_H, *_L, *_D, "LINE: a {x.mp3} {y.mp3}"], ["w8 multiple-inline-clips"]),
    ([*_H, *_L, *_D, "LINE: a {x.png} {y.png}"], ["w8 multiple-inline-images"]),
    ([*_H, *_L, *_P, "PROMPT: p", "RESPONSE: r {x.png}"], ["w9 response-with-image"]),
    ([*_H, "TITLE: t", *_L], ["e6 legacy-title-field"]),
    ([*_H, "IMAGE: i", *_L], ["e6 legacy-image-field-header"]),
    ([*_H, "FORMAT: 2", *_L], ["w6 dup-header-field"]),
    ([*_H, *_L, *_D, "SPEAKER: x"], ["e8 legacy-speaker-field"]),
    ([*_H, *_L, *_D, "IMAGE: x"], ["e8 legacy-image-field"]),
    ([*_H, *_L, "$GRAMMAR G", "NOTE: y"], ["w8 field-unexpected", "w8 grammar-field-swallowed"]),
    ([*_H, *_L, *_S, "PROMPT:", "ANSWER: b"], ["w8 empty-prompt"]),
    ([*_H, *_L, *_S, "ANSWER: a"], ["w8 answer-before-prompt"]),
    ([*_H, *_L, *_S, "PROMPT: p", "ANSWER:"], ["w9 empty-answer"]),
    ([*_H, *_L, *_P, "INPUT: shout"], ["w8 input-invalid"]),
    ([*_H, *_L, *_P, "CHECK: maybe"], ["w8 check-invalid"]),
    ([*_H, *_L, *_P, "RESPONSE: r"], ["w8 response-before-stimulus"]),
    ([*_H, *_L, *_P, "PROMPT: p", "RESPONSE:"], ["w9 empty-response"]),
    ([*_L, "FORMAT: 2"], ["e1 missing-module", "w2 header-before-module"]),
    ([*_H, *_L, "LINE: x"], ["w7 field-outside-activity"]),
    (["just words"], ["e1 no-sections", "e1 missing-module", "w1 content-outside"]),
    ([_H[0], *_H[2:], *_L], ["w1 missing-format"]),
    ([*_H[:2], *_H[3:], *_L], ["w1 missing-dioco-doc-id"]),
    ([*_H[:4], *_L], ["e1 missing-home-lang"]),
    ([*_H, "VOICE_SPEAKER: bob = Puck", *_L], ["w6 voice_speaker-deprecated"]),
    ([*_H, "VOICE_SPEAKER: bob", *_L], ["e6 voice_speaker-format", "w6 voice_speaker-deprecated"]),
    ([*_H, "VOICE_SPEAKER: bob b = Puck", *_L], ["w6 voice_speaker-deprecated", "w6 voice_speaker-label"]),
    ([*_H, "VOICE_DEFAULT: Pu ck", *_L], ["e6 voice-invalid", "w6 voice_name"]),
    ([*_H, "VOICE_SPEAKER: bob = Puck", "VOICE_SPEAKER: Bob = Puck", *_L], ["w6 voice_speaker-deprecated", "w7 voice_speaker-deprecated", "w7 voice_speaker-dup", "w7 voice_speaker-case"]),
    ([*_H, "VOICE: Bob", *_L], ["e6 voice-format"]),
    ([*_H, "VOICE: b b | Puck", *_L], ["w6 voice-speaker-id"]),
    ([*_H, *_L, *_D, "LINE: fine"], []),
]


def lint_faults(spark, d):
    """Each part is a module with one of these faults; all its diagnostics, in order (2.9)."""
    texts = F.array(*[F.lit("\n".join(text)) for text, _ in FAULTS])
    docs = R.table(spark, d, "part").select(s("p_partkey").alias("doc"), F.element_at(texts, (F.col("p_partkey") % len(FAULTS) + 1).cast("int")).alias("text"))
    return lint(docs).select("doc", F.col("seq").cast("int").alias("seq"), "severity", F.col("line").cast("int").alias("line"), "code")


def _modules(spark, d):
    """A module per part with a clip line; every fourth has one more, every fifth lacks a language, every seventh an id."""
    k, n = F.col("p_partkey"), s("p_partkey")
    lack = lambda m, line: F.when(k % m == 0, F.lit("# none")).otherwise(F.lit(line))
    more = F.when(k % 4 == 0, F.concat(F.lit("\nLINE: b {d"), n, F.lit(".mp3}"))).otherwise("")
    text = R.joined("$MODULE Parts", "FORMAT: 2", lack(7, "DIOCO_DOC_ID: d"), lack(5, "TARGET_LANG_G: fr"), "HOME_LANG_G: en", *_L, *_D, F.concat(F.lit("LINE: a {c"), n, F.lit(".mp3}"), more))
    return R.table(spark, d, "part").select(n.alias("doc"), text.alias("text"))


def _clips(spark, d):
    return R.table(spark, d, "part").where("p_partkey % 3 <> 0").select(F.concat(F.lit("c"), s("p_partkey"), F.lit(".mp3")).alias("name"))


def _sources(spark, d):
    return R.table(spark, d, "part").select(F.concat(F.lit("s"), s("p_partkey")).alias("doc"), R.joined("x", F.concat(F.lit("  LINE: a {c"), s("p_partkey"), F.lit(".mp3} ")), "LINE: no clip").alias("text"))


def staging_gate(spark, d):
    """What keeps modules from being staged (2.9b)."""
    return V.staging_faults(_modules(spark, d), _sources(spark, d), _clips(spark, d))


def clip_drift(spark, d):
    """Clip lines that no source module has."""
    return A.unknown_clip_lines(M.lines(_modules(spark, d)), M.lines(_sources(spark, d))).select("doc", F.col("ln").cast("int").alias("ln"), "raw")


def slice_output(spark, d):
    """What is wrong with sliced modules (2.9b)."""
    k, n = F.col("p_partkey"), s("p_partkey")
    text = R.joined(F.when(k % 11 == 0, "MODULE Parts").otherwise("$MODULE Parts"), F.when(k % 5 == 0, " TARGET_LANG_G: fr").otherwise("TARGET_LANG_G: fr"), "HOME_LANG_G: en", F.concat(F.lit("LINE: {c"), n, F.lit(".mp3}"), F.when(k % 4 == 0, " {e.mp3@1.5-2}").otherwise(""), F.lit(" {a phrase} {d.mp3}")))
    return V.slice_faults(R.table(spark, d, "part").select(n.alias("doc"), text.alias("text")), _clips(spark, d))


def run_counts(spark, d):
    """Events as the items of a user's run (A10)."""
    state = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "skipped").when(F.col("event_type") == "signup", "started").otherwise("success")
    return V.run_counters(R.table(spark, d, "events").select("user_id", state.alias("state")), "user_id")


def activity_sizes(spark, d):
    """Items of each order's activity."""
    return M.items_per_activity(M.parse(R.selections(spark, d))).select("doc", "act_no", "type", F.col("n_items").cast("long").alias("n_items"))


def _mixed(spark, d):
    """A module per customer with one activity of each type."""
    k = s("c_custkey")
    text = R.joined("$MODULE m", "$LESSON A", "$GRAMMAR G", "words", F.concat(F.lit("$DIALOGUE D"), k), "Bob: hi", "Ann:", "LINE: there", "$CHAT C", "SCENARIO: s", "$PRODUCE P", "PROMPT:", "RESPONSE: r", "", "TEMPLATE: t", "$SELECT S", "OPTION: a | b")
    return M.parse(R.table(spark, d, "customer").select(k.alias("doc"), text.alias("text")))


def mixed_sizes(spark, d):
    """Lines and items of each type: a line without text is none, an item needs a prompt, though an empty one counts."""
    return M.items_per_activity(_mixed(spark, d)).select("doc", "act_no", "type", F.col("n_items").cast("long").alias("n_items"))


def timed_activities(spark, d):
    """Activities with a place on the timeline."""
    return L.playable(M.activities(_mixed(spark, d))).select("doc", F.col("act_no").cast("int").alias("act_no"), "type")


def nested_modules(spark, d):
    """Whole modules as JSON, items in activities in lessons."""
    return M.nested(M.parse(R.selections(spark, d))).select("doc", F.md5(F.to_json("lessons")).alias("module"))


def code_order(spark, d):
    """Places of codes by their characters and by their numbers."""
    rows = R.table(spark, d, "part").select(F.floor(F.col("p_partkey") / 150).alias("book"), F.concat(F.lit("l"), s("p_partkey"), F.lit("A")).alias("code"))
    return C.places(rows, ["book"], "code").select("code", "by_code", "by_number")


def lesson_lookup(spark, d):
    """One lesson of a manifest."""
    return C.lesson_of(R.table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", 7)


def first_matches(spark, d):
    """The first line item of each order with a large quantity."""
    rows = R.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return A.first_match(rows, ["l_orderkey"], order, F.col("l_quantity") >= 25).select("l_orderkey", "l_linenumber", "l_partkey")


def reports(spark, d):
    """The first three documents of each hundred ids, their texts cut for the page."""
    rows = R.table(spark, d, "documents").select(F.floor(F.col("doc_id") / 100).alias("book"), "doc_id", "text")
    return V.report(rows, ["book"], F.col("doc_id"), 3, "text", 80).select("doc_id", "place", "text")


def manifest_updates(spark, d):
    """Part types with the translations that there are; others stay as they were."""
    rows = R.table(spark, d, "part").select("p_partkey", F.col("p_type").alias("en"), F.when(F.col("p_partkey") % 2 == 0, "old").alias("ru"))
    done = rows.select("en").distinct().where("en < 'P'").select("en", F.when(F.col("en") < "M", F.lower("en")).otherwise("").alias("other"))
    return sinks.updated_manifest(rows, done)


def copy_plans(spark, d):
    """What to copy where, and what is missing."""
    k, n = F.col("p_partkey"), s("p_partkey")
    refs = R.table(spark, d, "lineitem").select(F.concat(F.lit("p"), s("l_partkey"), F.when(F.col("l_partkey") % 2 == 0, ".png").otherwise(".mp3")).alias("name"))
    have = R.table(spark, d, "part").where("p_partkey % 3 > 0").select(F.concat(F.lit("p"), n, F.when(k % 2 == 0, ".png").otherwise(".mp3")).alias("name"), F.explode(F.array(F.lit("b/"), F.lit("a/"))).alias("folder"))
    return A.copy_plan(refs, have.select("name", F.concat("folder", "name").alias("path")))


def markdown_notes(spark, d):
    """Notes as HTML."""
    name, k = F.col("p_name"), s("p_partkey")
    md = F.concat(F.lit("## "), name, F.lit("\n\nSay **"), name, F.lit("** or *now* {"), name, F.lit("} & go\n- one\n- two\n\n|a|"), k, F.lit("|\n|--|:-|\nend ![alt](x"), k, F.lit(".png)"))
    return R.table(spark, d, "part").select("p_partkey", T.markdown_html(md).alias("html"))


def image_sizes(spark, d):
    """Sizes from the heads of images."""
    number = lambda c: F.lpad(F.hex(c), 8, "0")
    head = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number(F.col("p_partkey") + 70000), number(F.col("p_size"))))
    return R.table(spark, d, "part").select("p_partkey", T.png_size(head)["width"].alias("width"), T.png_size(head)["height"].alias("height"))


def gap_sessions(spark, d):
    """Each user's events by pauses of ten hours or more (T07); the same operator runs on a stream."""
    rows = R.table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    out = sessions(rows, ["user_id"], "10 hours")
    return out.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


def _faults_sql() -> str:
    rows = []
    for k, (_, found) in enumerate(FAULTS):
        order = sorted(range(len(found)), key=lambda n: (found[n][0], int(found[n][1:].split()[0]), n))  # errors first, then by line
        rows += [(k, place + 1, "error" if found[n][0] == "e" else "warning", int(found[n][1:].split()[0]), found[n].split()[1]) for place, n in enumerate(order)]
    values = ", ".join(f"({k}, {seq}, '{severity}', {line}, '{code}')" for k, seq, severity, line, code in rows)
    return f"WITH f(k, seq, severity, line, code) AS (VALUES {values}) SELECT CAST(p_partkey AS VARCHAR) AS doc, CAST(seq AS INT) AS seq, severity, CAST(line AS INT) AS line, code FROM part JOIN f ON p_partkey % {len(FAULTS)} = k"


SQL = {
    "lint_faults": _faults_sql(),
    "staging_gate": """
WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS doc, p_partkey AS k FROM part)
SELECT doc, 'lint' AS gate, CAST(1 AS BIGINT) AS n FROM p WHERE k % 5 = 0 UNION ALL SELECT doc, 'clip-text', 1 FROM p WHERE k % 4 = 0
UNION ALL SELECT doc, 'files', (k % 3 = 0)::BIGINT + (k % 4 = 0)::BIGINT FROM p WHERE k % 3 = 0 OR k % 4 = 0""",
    "clip_drift": "SELECT CAST(p_partkey AS VARCHAR) AS doc, CAST(9 AS INT) AS ln, 'LINE: b {d' || p_partkey || '.mp3}' AS raw FROM part WHERE p_partkey % 4 = 0",
    "slice_output": """
WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS doc, p_partkey AS k FROM part)
SELECT doc, 'missing-title' AS fault, CAST(1 AS BIGINT) AS n FROM p WHERE k % 11 = 0
UNION ALL SELECT doc, 'missing-target-lang', 1 FROM p WHERE k % 5 = 0 UNION ALL SELECT doc, 'leftover-timing', 1 FROM p WHERE k % 4 = 0
UNION ALL SELECT doc, 'missing-files', 1 + (k % 3 = 0)::BIGINT FROM p""",
    "run_counts": "SELECT user_id, count(*) AS total, count(*) FILTER (event_type NOT IN ('error', 'view', 'signup')) AS success, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'view') AS skipped, count(*) FILTER (event_type <> 'signup') AS processed FROM events GROUP BY user_id",
    "activity_sizes": "SELECT CAST(o_custkey AS VARCHAR) AS doc, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS act_no, 'SELECT' AS type, n AS n_items FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey",
    "mixed_sizes": "SELECT CAST(c_custkey AS VARCHAR) AS doc, act_no, type, n_items FROM customer, (VALUES (1, 'GRAMMAR', NULL), (2, 'DIALOGUE', 2), (3, 'CHAT', NULL), (4, 'PRODUCE', 2), (5, 'SELECT', 0)) t(act_no, type, n_items)",
    "timed_activities": "SELECT CAST(c_custkey AS VARCHAR) AS doc, CAST(act_no AS INT) AS act_no, type FROM customer, (VALUES (2, 'DIALOGUE'), (4, 'PRODUCE'), (5, 'SELECT')) t(act_no, type)",
    "nested_modules": """
WITH i AS (SELECT o_custkey, o_orderkey, l_partkey, l_returnflag, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS no FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS act_no, string_agg('{"no":' || no || ',"prompt":"Part ' || l_partkey || '","answer":"' || l_returnflag || '"}', ',' ORDER BY no) AS items FROM i GROUP BY o_custkey, o_orderkey)
SELECT CAST(o_custkey AS VARCHAR) AS doc, md5('[{"lesson_no":1,"id":"orders","title":"Orders","activities":[' || string_agg('{"act_no":' || act_no || ',"type":"SELECT","id":"select-order-' || o_orderkey || '","title":"Order ' || o_orderkey || '","items":[' || items || ']}', ',' ORDER BY act_no) || ']}]') AS module FROM a GROUP BY o_custkey""",
    "code_order": "SELECT 'l' || p_partkey || 'A' AS code, row_number() OVER (PARTITION BY p_partkey // 150 ORDER BY 'l' || p_partkey || 'A') AS by_code, row_number() OVER (PARTITION BY p_partkey // 150 ORDER BY p_partkey) AS by_number FROM part",
    "lesson_lookup": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7",
    "first_matches": "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem WHERE l_quantity >= 25) WHERE n = 1",
    "reports": "SELECT doc_id, CAST(place AS INT) AS place, left(text, 80) AS text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) AS place FROM documents) WHERE place <= 3",
    "manifest_updates": "SELECT p_partkey, p_type AS en, CASE WHEN p_type < 'M' THEN lower(p_type) WHEN p_partkey % 2 = 0 THEN 'old' END AS ru FROM part",
    "copy_plans": """
WITH r AS (SELECT DISTINCT l_partkey AS k, 'p' || l_partkey || CASE WHEN l_partkey % 2 = 0 THEN '.png' ELSE '.mp3' END AS name FROM lineitem), x AS (SELECT name, k, k % 3 > 0 AND k IN (SELECT p_partkey FROM part) AS ok FROM r)
SELECT name, CASE WHEN ok THEN 'a/' || name END AS source, CASE WHEN ok AND k % 2 = 0 THEN 'images/' || name WHEN ok THEN 'audio/' || name END AS target, CASE WHEN ok THEN 'copied' ELSE 'missing' END AS state FROM x""",
    "markdown_notes": """
SELECT p_partkey, '<h4>' || p_name || '</h4><p>Say <strong>' || p_name || '</strong> or <em>now</em> <span class="audio-phrase">' || p_name || '</span> &amp; go' || chr(10) || '<ul><li>one</li>' || chr(10) || '<li>two</li>' || chr(10) || '</ul>' || chr(10)
 || '<table><tr><td>a</td><td>' || p_partkey || '</td></tr>' || chr(10) || '</table>' || chr(10) || 'end <img class="md-img" src="x' || p_partkey || '.png" alt="alt" /></p>' AS html FROM part""",
    "image_sizes": "SELECT p_partkey, CAST(p_partkey + 70000 AS BIGINT) AS width, CAST(p_size AS BIGINT) AS height FROM part",
    "gap_sessions": """
WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events), b AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 36000000000 THEN 0 ELSE 1 END AS new FROM e),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t) AS n FROM b)
SELECT user_id, min(t) AS start, max(t) + 36000000000 AS "end", count(*) AS n FROM n GROUP BY user_id, n.n""",
}
_FUNCTIONS = (lint_faults, staging_gate, clip_drift, slice_output, run_counts, activity_sizes, mixed_sizes, timed_activities, nested_modules, code_order, lesson_lookup, first_matches, reports, manifest_updates, copy_plans, markdown_notes, image_sizes, gap_sessions)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
