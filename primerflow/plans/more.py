"""Queries of figures, validators, sinks and books over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog as C
from ..operators import figures as G
from ..operators import module as M
from ..operators import timeline as L
from ..operators import validate as V
from ..operators.lint import lint, severity_counts
from ..sources import files, sinks
from . import render as R

s = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")


def linked_images(spark, d):
    """Line items as segments of orders, parts' images by number; the last of an index counts."""
    li = R.table(spark, d, "lineitem")
    segments = li.select(F.col("l_orderkey").alias("fig"), F.col("l_linenumber").alias("item_number"))
    images = li.where("l_partkey % 2 = 0").select(F.col("l_orderkey").alias("fig"), F.col("l_linenumber").alias("idx"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("pos"), s("l_partkey").alias("path"))
    scripts = R.table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("fig"))
    return G.linked_images(segments, images, scripts).groupBy("fig", "item_number", "image").agg(F.count("*").alias("n"))


def image_boxes(spark, d):
    """Images with boxes of four numbers."""
    images = R.table(spark, d, "part").select(F.col("p_size").alias("page"), F.col("p_partkey").alias("id"))
    k = F.col("p_partkey")
    boxes = R.table(spark, d, "part").where("p_partkey % 3 > 0").select(F.col("p_size").alias("page"), k.alias("id"), F.slice(F.array(k, k + 1, k + 2, k + 3), F.lit(1), (4 - (k % 5 == 0).cast("int"))).alias("box"))
    return G.with_boxes(images, boxes).select("page", "id", F.array_join("box", ",").alias("box"))


def raw_blocks(spark, d):
    """Activities with the lines of their block, by id."""
    ctx = M.parse(R.selections(spark, d))
    blocks = M.block_ranges(ctx).where("marker = 'SELECT'").select("doc", T.slug(F.concat(F.lit("select-"), F.col("title"))).alias("activity_id"), "start_line", F.col("end_line").cast("int").alias("end_line"))
    return G.raw_blocks(M.activities(ctx).select("doc", "id"), blocks).select("doc", "id", (F.col("end_line") - F.col("start_line") + 1).alias("n_lines"))


def diagnostic_lines(spark, d):
    """Diagnostics with the text of their line."""
    docs = R.faulty(spark, d)
    return G.at_source(lint(docs).where("code = 'unknown-header-field'"), M.lines(docs)).select("doc", "ln", "raw")


def diagnostic_counts(spark, d):
    """Errors and warnings of each document."""
    return severity_counts(lint(R.faulty(spark, d)))


def token_times(spark, d):
    """Times of tokens: their words' where counts agree, else spread."""
    k = F.col("event_id")
    tokens, words = F.transform(F.sequence(F.lit(1), (k % 4 + 1).cast("int")), lambda x: x.cast("string")), F.transform(F.sequence(F.lit(1), (k % 3 + 1).cast("int")), lambda x: x * 1.5)
    out = G.token_times(tokens, words, F.lit(0.0), F.col("value"))
    return R.table(spark, d, "events").select("event_id", F.size(out).alias("n"), T.nearest(F.element_at(out, -1), 3).alias("last"))


def display_modes(spark, d):
    """Display modes of figures with and without images (P37), hidden prompts."""
    e = R.table(spark, d, "events")
    activity = F.when(F.col("event_type") == "view", "dictation").when(F.col("event_type") == "click", "listen_circle").when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))
    images = F.col("event_id") % 2
    hidden = L.audio_only(F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 5 > 0, F.lit("a.mp3")))
    return e.groupBy(G.effective_activity(images, activity).alias("activity"), G.display_mode(images, activity).alias("mode"), hidden.alias("hidden")).agg(F.count("*").alias("n"))


def lesson_codes(spark, d):
    """Codes of lessons from names and titles (P50), paths with a fallback."""
    k = F.col("p_partkey")
    file = F.concat(F.lit("lesson-"), (k % 30).cast("string"), F.lit("a.module"))
    title = F.when(k % 2 == 0, F.concat((k % 9).cast("string"), F.lit(". Story"))).otherwise("Story")
    return R.table(spark, d, "part").select("p_partkey", G.lesson_code(file, title, k, False).alias("code"), G.lesson_code(file, title, k, True).alias("story"), G.public_path(F.when(k % 3 == 0, F.lit("pub/x.png")), F.concat(F.lit("a/b"), k.cast("string"), F.lit(".png"))).alias("path"))


def keyword_scores(spark, d):
    """Documents scored by words that must and must not be there."""
    docs = R.table(spark, d, "documents")
    truth = docs.select(F.col("source").alias("model"), F.col("doc_id").alias("panel"), F.array(F.lit("e"), F.lit("a")).alias("must"), F.array(F.lit("z")).alias("must_not"))
    return V.keyword_scores(docs.where("doc_id % 4 > 0").select(F.col("source").alias("model"), F.col("doc_id").alias("panel"), "text"), truth, ["model"])


def mean_latency(spark, d):
    """Mean of the values of an event type's good events."""
    rows = R.table(spark, d, "events").select(F.col("event_type").alias("model"), (F.col("value") * 100).cast("long").cast("double").alias("seconds"), ((F.col("event_type") != "error") & (F.col("event_id") % 2 == 0)).alias("ok"))
    return V.mean_latency(rows).select("model", T.nearest(F.col("seconds"), 4).alias("seconds"))


def module_warnings(spark, d):
    """Warnings about converted modules."""
    return V.module_warnings(R.faulty(spark, d)).groupBy("warning").agg(F.count("*").alias("n"))


def clip_faults(spark, d):
    k = F.col("event_id")
    clips = R.table(spark, d, "events").select(F.col("value").alias("start"), (F.col("value") + k % 3).alias("end"), (k % 5 > 0).alias("parsed"), (k % 7 > 0).alias("source_exists"))
    return V.clip_faults(clips).groupBy("fault").agg(F.count("*").alias("n"))


def subtitle_faults(spark, d):
    """Subtitles out of order, not monotonic or empty."""
    k = F.col("event_id")
    subs = R.table(spark, d, "events").select(F.col("user_id").alias("tape"), k.alias("pos"), (k * 10 - F.when(k % 11 == 0, 100000).otherwise(0)).alias("begin"), (k * 10 + F.when(k % 13 == 0, -200000).otherwise(5)).alias("end"), F.when(k % 17 == 0, " ").otherwise("x").alias("text"))
    return V.subtitle_faults(subs).select("tape", "pos", "fault")


def manifests(spark, d):
    """Manifests of orders with their lines in order."""
    o = R.table(spark, d, "orders")
    li = R.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("part"))
    segments = li.select(F.col("l_orderkey").alias("lesson"), F.col("l_linenumber").alias("seg_no"), "part")
    return sinks.manifest(o.select(F.col("o_orderkey").alias("lesson"), F.col("o_orderpriority").alias("title")), segments)


def split_files(spark, d):
    """Documents cut after every fifth line into numbered files with the first heading in their name; files that exist,
    the first of every second document, are left out (K06)."""
    marked = F.array_join(F.transform(F.split("text", "\n"), lambda x, k: F.when(k % 5 == 4, F.concat(x, F.lit("\n@@@\n# Part/Two"))).otherwise(x)), "\n")
    docs = R.table(spark, d, "documents").select(s("doc_id").alias("doc"), F.concat(F.lit("intro\n"), marked).alias("text"))
    have = docs.where("doc % 2 = 0").select("doc", F.lit("001.md").alias("name"))
    return sinks.split_documents(docs, "@@@", have).select("doc", "name", F.md5("text").alias("text"))


def sliced_drafts(spark, d):
    """Draft lines with folders and timings taken out."""
    k = s("p_partkey")
    rows = R.table(spark, d, "part").select(s(F.floor(F.col("p_partkey") / 50)).alias("doc"), F.col("p_partkey").alias("ln"), F.concat(F.lit("LINE: x {img/p"), k, F.lit(".jpg} {c"), k, F.lit(".mp3@1.25-3}")).alias("raw"))
    return sinks.sliced(rows).select("doc", F.md5("text").alias("text"))


def lesson_books(spark, d):
    """Figures of lesson books rendered from orders: a bold line, an image and a text an order."""
    o = R.table(spark, d, "orders")
    k = s("o_orderkey")
    fig = R.joined(F.concat(F.lit("## Figure "), k), F.concat(F.lit("**"), F.col("o_orderpriority"), F.lit("**")), "**second**", F.concat(F.lit("1. ![#7 cap]("), k, F.lit(".png)")), F.concat(F.lit("2. text "), k))
    books = R.gathered(o, ["o_custkey"], ["o_orderkey"], fig, "body")
    docs = books.select(s("o_custkey").alias("doc"), R.joined("# UNIT LESSON 1A", F.col("body"), "# LESSON 1B", "## Figure 1").alias("text"))
    out = files.lesson_book(docs)
    return out.select("doc", "fig", "instruction", F.get("items.image.path", F.lit(0)).alias("path"), F.get("items.image.panel", F.lit(0)).alias("panel"), F.get("items.text", F.lit(1)).alias("text"))


def course_files(spark, d):
    """Keys of course files, the last of each."""
    n = R.table(spark, d, "nation")
    docs = n.select(s("n_nationkey").alias("doc"), R.joined("# course", "TITLE: first", F.concat(F.lit("TITLE: "), F.col("n_name"), F.lit(": x")), "", "TARGET_LANG_G: fr", "no colon").alias("text"))
    return M.parse_course(docs)


def grammar_texts(spark, d):
    """Grammar notes parsed back: headings are comments, blank lines stay."""
    docs = R.table(spark, d, "nation").select(s("n_nationkey").alias("doc"), R.joined("$MODULE m", "$GRAMMAR G", "# gone", F.col("n_name"), "", "NOTE: y", "INTRO: i").alias("text"))
    return M.grammar(M.parse(docs)).select("doc", "content")


def repo_rows(spark, d):
    """Customers as a service's replies, flattened."""
    k, name = F.col("c_custkey"), F.concat(F.lit("r"), s("c_custkey"))
    raw = R.table(spark, d, "customer").select(
        name.alias("name"), F.concat(F.lit("o/"), name).alias("full_name"), F.struct(F.lit("o").alias("login"), F.when(k % 3 == 0, F.col("c_name")).when(k % 3 == 1, "").alias("full_name")).alias("owner"), (k % 2 == 0).alias("fork"),
        F.when(k % 2 == 0, F.struct(F.lit("p/x").alias("full_name"))).alias("parent"), (k % 5 == 0).alias("private"), F.when(k % 4 > 0, F.struct((k % 4 == 1).alias("push"))).alias("permissions"), F.lit("2024").alias("updated_at"),
    )
    return C.repo_rows(raw).select("name", "owner_display", "is_fork", "parent_full_name", "is_private", "can_push")


def prompt_documents(spark, d):
    """Prompts of regions from their nations; every third is missing."""
    n = R.table(spark, d, "nation")
    parts = n.select(s("n_regionkey").alias("doc"), F.col("n_nationkey").alias("place"), F.lit("Part").alias("title"), F.when(F.col("n_nationkey") % 3 == 1, None).when(F.col("n_nationkey") % 3 == 2, " ").otherwise(F.col("n_name")).alias("text"))
    return C.prompt_documents(parts)


SQL = {
    "repo_rows": "SELECT 'r' || c_custkey AS name, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'o' END AS owner_display, c_custkey % 2 = 0 AS is_fork, CASE WHEN c_custkey % 2 = 0 THEN 'p/x' END AS parent_full_name, c_custkey % 5 = 0 AS is_private, c_custkey % 4 = 1 AS can_push FROM customer",
    "prompt_documents": "SELECT CAST(n_regionkey AS VARCHAR) AS doc, coalesce(string_agg(CASE WHEN n_nationkey % 3 = 0 THEN '## Part' || chr(10) || chr(10) || n_name END, chr(10) || chr(10) ORDER BY n_nationkey), '') AS text FROM nation GROUP BY n_regionkey",
    "linked_images": """
WITH i AS (SELECT l_orderkey, l_linenumber, arg_max(CAST(l_partkey AS VARCHAR), l_partkey * 1000 + l_suppkey) AS image FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY ALL)
SELECT l.l_orderkey AS fig, l.l_linenumber AS item_number, i.image, count(*) AS n FROM lineitem l JOIN orders ON o_orderkey = l.l_orderkey AND o_orderstatus <> 'P' LEFT JOIN i ON i.l_orderkey = l.l_orderkey AND i.l_linenumber = l.l_linenumber GROUP BY ALL""",
    "image_boxes": "SELECT p_size AS page, p_partkey AS id, CASE WHEN p_partkey % 3 > 0 AND p_partkey % 5 > 0 THEN p_partkey || ',' || p_partkey + 1 || ',' || p_partkey + 2 || ',' || p_partkey + 3 END AS box FROM part",
    "raw_blocks": "SELECT CAST(o_custkey AS VARCHAR) AS doc, 'select-order-' || o_orderkey AS id, CAST(5 + sum(CASE WHEN l_linenumber % 4 = 0 THEN 5 ELSE 4 END) AS INT) AS n_lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, o_orderkey",
    "diagnostic_lines": "SELECT CAST(p_partkey AS VARCHAR) AS doc, CAST(7 AS INT) AS ln, 'COLOUR: red' AS raw FROM part WHERE p_partkey % 16 = 4",
    "diagnostic_counts": """
WITH f(k, e, w) AS (VALUES (0,1,0),(1,1,0),(2,1,0),(3,1,0),(4,0,1),(5,1,1),(6,0,1),(7,0,1),(8,0,1),(9,0,1),(10,1,7),(11,0,1),(12,0,1),(13,0,1),(14,0,1),(15,0,1))
SELECT CAST(p_partkey AS VARCHAR) AS doc, CAST(e AS BIGINT) AS errors, CAST(w AS BIGINT) AS warnings FROM part JOIN f ON p_partkey % 16 = k""",
    "token_times": "SELECT event_id, CAST(event_id % 4 + 1 AS INT) AS n, floor(CASE WHEN event_id % 4 = event_id % 3 THEN (event_id % 3 + 1) * 1.5 ELSE (event_id % 4) * value / (event_id % 4 + 1) END * 1000 + 0.5) / 1000 AS last FROM events",
    "display_modes": """
WITH a AS (SELECT *, CASE event_type WHEN 'view' THEN 'dictation' WHEN 'click' THEN 'listen_circle' WHEN 'error' THEN 'other' ELSE event_type END AS act, event_id % 3 <> 0 AND event_id % 5 > 0 AS hidden FROM events)
SELECT CASE WHEN event_id % 2 > 0 THEN 'repeat_vocab' ELSE act END AS activity, CASE WHEN event_id % 2 = 0 AND act IN ('dictation', 'listen_circle') THEN 'listen' ELSE 'readAlong' END AS mode, hidden, count(*) AS n FROM a GROUP BY ALL""",
    "lesson_codes": "SELECT p_partkey, p_partkey % 30 || 'A' AS code, 'S' || CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 9 ELSE p_partkey END AS story, CASE WHEN p_partkey % 3 = 0 THEN 'pub/x.png' ELSE 'images/b' || p_partkey || '.png' END AS path FROM part",
    "keyword_scores": "SELECT source AS model, count(*) FILTER (doc_id % 4 > 0 AND contains(lower(text), 'e') AND contains(lower(text), 'a') AND NOT contains(lower(text), 'z')) AS correct, count(*) AS total FROM documents GROUP BY source",
    "mean_latency": "SELECT event_type AS model, floor(coalesce(avg(CAST(CAST(trunc(value * 100) AS BIGINT) AS DOUBLE)) FILTER (event_type <> 'error' AND event_id % 2 = 0), 0) * 10000 + 0.5) / 10000 AS seconds FROM events GROUP BY event_type",
    "module_warnings": "WITH f(k, warning) AS (VALUES (2, 'missing-target-lang'), (10, 'colon')) SELECT warning, count(*) AS n FROM part JOIN f ON p_partkey % 16 = k GROUP BY warning",
    "clip_faults": "SELECT CASE WHEN event_id % 3 = 0 THEN 'empty' WHEN event_id % 5 = 0 THEN 'name' WHEN event_id % 7 = 0 THEN 'source' END AS fault, count(*) AS n FROM events GROUP BY 1",
    "subtitle_faults": """
WITH q AS (SELECT user_id AS tape, event_id AS pos, event_id * 10 - CASE WHEN event_id % 11 = 0 THEN 100000 ELSE 0 END AS b, event_id * 10 + CASE WHEN event_id % 13 = 0 THEN -200000 ELSE 5 END AS e, event_id % 17 = 0 AS blank FROM events),
p AS (SELECT *, lag(b) OVER (PARTITION BY tape ORDER BY pos) AS prev FROM q)
SELECT tape, pos, CASE WHEN b >= e THEN 'order' WHEN prev > b THEN 'not monotonic' ELSE 'empty' END AS fault FROM p WHERE b >= e OR prev > b OR blank""",
    "manifests": """
WITH l AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS part FROM lineitem GROUP BY ALL),
g AS (SELECT l_orderkey, string_agg('{"seg_no":' || l_linenumber || ',"part":' || part || '}', ',' ORDER BY l_linenumber) AS j FROM l GROUP BY l_orderkey)
SELECT o_orderkey AS lesson, '{"fps":30,"width":1920,"height":1080,"lesson":' || o_orderkey || ',"title":"' || o_orderpriority || '"' || coalesce(',"segments":[' || j || ']', '') || '}' AS json FROM orders LEFT JOIN g ON l_orderkey = o_orderkey""",
    "split_files": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
p AS (SELECT doc_id, (k - 1) // 5 AS part, string_agg(line, chr(10) ORDER BY k) AS t FROM l GROUP BY ALL
  UNION ALL SELECT doc_id, max(k) // 5, NULL FROM l GROUP BY doc_id HAVING max(k) % 5 = 0),
q AS (SELECT doc_id, part, CASE WHEN part = 0 THEN 'intro' ELSE '# Part/Two' END || coalesce(chr(10) || t, '') AS t FROM p)
SELECT CAST(doc_id AS VARCHAR) AS doc, lpad(CAST(part + 1 AS VARCHAR), 3, '0') || CASE WHEN part > 0 THEN ' - Part Two' ELSE '' END || '.md' AS name, md5(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS text FROM q WHERE part > 0 OR doc_id % 2 = 1""",
    "sliced_drafts": "SELECT CAST(p_partkey // 50 AS VARCHAR) AS doc, md5(string_agg('LINE: x {p' || p_partkey || '.jpg} {c' || p_partkey || '.mp3}', chr(10) ORDER BY p_partkey)) AS text FROM part GROUP BY p_partkey // 50",
    "lesson_books": "SELECT CAST(o_custkey AS VARCHAR) AS doc, CAST(o_orderkey AS INT) AS fig, o_orderpriority AS instruction, o_orderkey || '.png' AS path, CAST(7 AS INT) AS panel, 'text ' || o_orderkey AS text FROM orders",
    "course_files": "SELECT CAST(n_nationkey AS VARCHAR) AS doc, 'TITLE' AS key, n_name || ': x' AS value FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'TARGET_LANG_G', 'fr' FROM nation",
    "grammar_texts": "SELECT CAST(n_nationkey AS VARCHAR) AS doc, n_name || chr(10) || chr(10) || 'NOTE:y' AS content FROM nation",
}
_FUNCTIONS = (linked_images, image_boxes, raw_blocks, diagnostic_lines, diagnostic_counts, token_times, display_modes, lesson_codes, keyword_scores, mean_latency, module_warnings, clip_faults, subtitle_faults, manifests, split_files, sliced_drafts, lesson_books, course_files, grammar_texts, repo_rows, prompt_documents)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
