"""Queries over parsed module text, and the same answers from the tables that the text was made from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import module as M
from ..operators.lint import lint
from . import render as R


def dialogue_counts(spark, d):
    """Dialogue lines per document and speaker."""
    rows = M.dialogue_lines(M.parse(R.dialogues(spark, d)))
    return rows.groupBy("doc", "speaker").agg(F.count("*").alias("n_lines"))


def dialogue_lines(spark, d):
    return M.dialogue_lines(M.parse(R.dialogues(spark, d))).select("doc", F.col("line_no").cast("int").alias("line_no"), "speaker", "text")


def line_classes(spark, d):
    """Lines of each kind."""
    return M.classify(M.lines(R.dialogues(spark, d))).groupBy("doc", "kind").agg(F.count("*").alias("n"))


def module_counts(spark, d):
    return M.list_item(M.parse(R.selections(spark, d)))


def module_header(spark, d):
    return M.header(M.parse(R.dialogues(spark, d))).select("doc", "title", "module_key", "target_lang", "home_lang", F.size("missing").alias("n_missing"))


def activity_rows(spark, d):
    rows = M.activities(M.parse(R.selections(spark, d)))
    return rows.select("doc", "lesson_no", "act_no", "type", "id", "title", "repeat")


def select_items(spark, d):
    rows = M.select_items(M.numbered(M.parse(R.selections(spark, d)), "SELECT"))
    return rows.select("doc", "act_no", "item_no", "prompt", "template", "prompt_image", "audio", F.array_join("answer", ",").alias("answer"), "is_example")


def select_answers(spark, d):
    """Items with the text of the option they answer, from the pool."""
    rows = M.numbered(M.parse(R.selections(spark, d)), "SELECT")
    out = M.item_options(M.select_items(rows), M.select_options(rows))
    return out.groupBy("doc", F.col("chosen.text").alias("chosen"), F.size("options").alias("n_options")).agg(F.count("*").alias("n"))


def select_pool(spark, d):
    rows = M.select_options(M.numbered(M.parse(R.selections(spark, d)), "SELECT"))
    return rows.groupBy("id", "pos", "text", "image").agg(F.count("*").alias("n"))


def produce_items(spark, d):
    rows = M.produce_items(M.numbered(M.parse(R.productions(spark, d)), "PRODUCE"))
    return rows.select("doc", "item_no", "prompt", "response", "response_audio", F.array_join("accept", "/").alias("accept"), "rubric")


def produce_modes(spark, d):
    return M.activities(M.parse(R.productions(spark, d))).select("doc", "lesson_no", "title", "input", "check", "show_prompt")


def lesson_rows(spark, d):
    return M.lessons(M.parse(R.productions(spark, d)))


def voice_rows(spark, d):
    return M.voices(M.parse(R.declared_voices(spark, d)))


def voice_lookup(spark, d):
    """Speakers of any case to their voice, else the default."""
    spec = M.voices(M.parse(R.declared_voices(spark, d)))
    asked = R.table(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("doc"), F.when(F.col("n_nationkey") % 4 == 1, F.concat(F.col("n_name"), F.lit("x"))).otherwise(F.lower("n_name")).alias("asked"))
    return M.voice_for(asked, spec)


def block_ranges(spark, d):
    return M.block_ranges(M.parse(R.dialogues(spark, d))).select("doc", "marker", "title", "start_line", F.col("end_line").cast("int").alias("end_line"))


def outline(spark, d):
    """Lessons with their number of activities."""
    return M.outline(M.parse(R.selections(spark, d))).select("doc", "id", "title", F.size("activities").alias("n_activities"))


def lint_codes(spark, d):
    return lint(R.faulty(spark, d)).groupBy("code", "severity").agg(F.count("*").alias("n"))


def lint_rows(spark, d):
    """All diagnostics with their place in the order of their document."""
    return lint(R.faulty(spark, d)).select("doc", F.col("seq").cast("int").alias("seq"), "code", F.col("line").cast("int").alias("line"))


_SAID = """
l AS (SELECT conv_id, turn, role, t.line, t.pos FROM conversations,
  LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos) t),
s AS (SELECT CAST(conv_id AS VARCHAR) AS doc, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, pos) AS line_no,
  upper(role[1]) || role[2:] AS speaker, trim(line) AS text FROM l WHERE trim(line) <> '')
"""
_ITEMS = """
i AS (SELECT o_custkey, o_orderkey, l.*, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS act_no,
  row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS item_no
  FROM orders JOIN lineitem l ON o_orderkey = l_orderkey)
"""
SQL = {
    "dialogue_counts": f"WITH {_SAID} SELECT doc, speaker, count(*) AS n_lines FROM s GROUP BY ALL",
    "dialogue_lines": f"WITH {_SAID} SELECT doc, CAST(line_no AS INT) AS line_no, speaker, text FROM s",
    "line_classes": """
WITH t AS (SELECT conv_id, role, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM conversations),
k AS (SELECT conv_id, CASE WHEN pos = 1 THEN 'raw' ELSE 'field' END AS kind FROM t
  UNION ALL SELECT conv_id, unnest(['marker','marker','marker','field','field','field','field','field','blank','comment','flag']) FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT CAST(conv_id AS VARCHAR) AS doc, kind, count(*) AS n FROM k GROUP BY ALL""",
    "module_counts": "SELECT CAST(o_custkey AS VARCHAR) AS doc, CAST(1 AS BIGINT) AS lessons, count(DISTINCT o_orderkey) AS activities FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY o_custkey",
    "module_header": "SELECT DISTINCT CAST(conv_id AS VARCHAR) AS doc, 'Talk ' || conv_id AS title, 'd' AS module_key, 'fr' AS target_lang, 'en' AS home_lang, CAST(0 AS INT) AS n_missing FROM conversations",
    "activity_rows": f"WITH {_ITEMS} SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS doc, CAST(1 AS INT) AS lesson_no, CAST(act_no AS INT) AS act_no, 'SELECT' AS type, 'select-order-' || o_orderkey AS id, 'Order ' || o_orderkey AS title, false AS repeat FROM i",
    "select_items": f"WITH {_ITEMS} SELECT CAST(o_custkey AS VARCHAR) AS doc, CAST(act_no AS INT) AS act_no, CAST(item_no AS INT) AS item_no, 'Part ' || l_partkey AS prompt, 'It is ____ ' || l_linestatus AS template, 'p' || l_partkey || '.jpg' AS prompt_image, 'c' || l_partkey || '.mp3' AS audio, l_returnflag AS answer, l_linenumber % 4 = 0 AS is_example FROM i",
    "select_answers": f"WITH {_ITEMS} SELECT CAST(o_custkey AS VARCHAR) AS doc, CASE l_returnflag WHEN 'A' THEN 'Accepted' WHEN 'N' THEN 'None' ELSE 'Returned' END AS chosen, CAST(3 AS INT) AS n_options, count(*) AS n FROM i GROUP BY ALL",
    "select_pool": "SELECT id, CAST(pos AS INT) AS pos, text, image, (SELECT count(DISTINCT o_orderkey) FROM orders JOIN lineitem ON o_orderkey = l_orderkey) AS n FROM (VALUES ('A', 1, 'Accepted', NULL), ('N', 2, 'None', 'new.png'), ('R', 3, 'Returned', NULL)) v(id, pos, text, image)",
    "produce_items": "SELECT CAST(p_partkey // 50 AS VARCHAR) AS doc, CAST(row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) AS INT) AS item_no, p_name AS prompt, p_brand AS response, 'r.mp3' AS response_audio, p_type || '/' || p_brand AS accept, 'same brand' AS rubric FROM part",
    "produce_modes": "SELECT DISTINCT CAST(p_partkey // 50 AS VARCHAR) AS doc, CAST(1 AS INT) AS lesson_no, 'Name the brand' AS title, 'speak' AS input, 'llm' AS check, true AS show_prompt FROM part",
    "lesson_rows": "SELECT DISTINCT CAST(p_partkey // 50 AS VARCHAR) AS doc, CAST(1 AS INT) AS lesson_no, 'default-lesson' AS id, 'Default Lesson' AS title FROM part",
    "voice_rows": """
SELECT CAST(n_regionkey AS VARCHAR) AS doc, 'speaker' AS slot, n_name AS speaker, ['Puck','kore','Zephyr'][n_nationkey % 3 + 1] AS voice, CASE WHEN n_nationkey % 2 = 0 THEN 'calm | slow' END AS prompt FROM nation
UNION ALL SELECT DISTINCT CAST(n_regionkey AS VARCHAR), 'default', NULL, 'Puck', 'warm' FROM nation""",
    "voice_lookup": "SELECT CAST(n_regionkey AS VARCHAR) AS doc, CASE WHEN n_nationkey % 4 = 1 THEN n_name || 'x' ELSE lower(n_name) END AS asked, CASE WHEN n_nationkey % 4 = 1 THEN 'Puck' ELSE ['Puck','kore','Zephyr'][n_nationkey % 3 + 1] END AS voice FROM nation",
    "block_ranges": """
WITH n AS (SELECT conv_id, sum(len(string_split(text, chr(10)))) AS body FROM conversations GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS doc, marker, title, CAST(a AS INT) AS start_line, CAST(b AS INT) AS end_line FROM (
SELECT conv_id, 'LESSON' AS marker, 'Lesson ' || conv_id AS title, 8 AS a, 8 AS b FROM n UNION ALL SELECT conv_id, 'DIALOGUE', 'Talk', 9, 11 + body FROM n)""",
    "outline": "SELECT CAST(o_custkey AS VARCHAR) AS doc, 'orders' AS id, 'Orders' AS title, CAST(count(DISTINCT o_orderkey) AS INT) AS n_activities FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY o_custkey",
    "lint_codes": """
WITH f(k, code, severity) AS (VALUES (0,'missing-title','error'),(1,'format-invalid','error'),(2,'missing-target-lang','error'),(3,'voice-invalid','error'),(4,'unknown-header-field','warning'),
 (5,'section-indent','error'),(5,'content-outside','warning'),(6,'speaker-empty-line','warning'),(7,'speaker-undeclared','warning'),(8,'raw-content','warning'),(9,'asset-not-trailing','warning'),
 (10,'section-colon','error'),(10,'section-format','warning'),(10,'field-unexpected','warning'),(10,'field-unexpected','warning'),(10,'field-unexpected','warning'),(10,'field-unexpected','warning'),(10,'field-unexpected','warning'),(10,'field-unexpected','warning'),
 (11,'option-format','warning'),(12,'select-missing-answer','warning'),(13,'item-needs-blank-line','warning'),(14,'dup-activity-id','warning'),(15,'example-not-applied','warning'))
SELECT code, severity, count(*) AS n FROM part JOIN f ON p_partkey % 16 = k GROUP BY ALL""",
    "lint_rows": """
WITH f(k, seq, code, line) AS (VALUES (0,1,'missing-title',1),(1,1,'format-invalid',2),(2,1,'missing-target-lang',1),(3,1,'voice-invalid',6),(4,1,'unknown-header-field',7),(5,1,'section-indent',10),(5,2,'content-outside',10),(6,1,'speaker-empty-line',12),
 (7,1,'speaker-undeclared',13),(8,1,'raw-content',14),(9,1,'asset-not-trailing',15),(10,1,'section-colon',17),(10,2,'section-format',17),(10,3,'field-unexpected',18),(10,4,'field-unexpected',19),(10,5,'field-unexpected',20),(10,6,'field-unexpected',21),(10,7,'field-unexpected',23),(10,8,'field-unexpected',24),
 (11,1,'option-format',19),(12,1,'select-missing-answer',20),(13,1,'item-needs-blank-line',23),(14,1,'dup-activity-id',26),(15,1,'example-not-applied',29))
SELECT CAST(p_partkey AS VARCHAR) AS doc, CAST(seq AS INT) AS seq, code, CAST(line AS INT) AS line FROM part JOIN f ON p_partkey % 16 = k""",
}

QUERIES = {f.__name__: f for f in (dialogue_counts, dialogue_lines, line_classes, module_counts, module_header, activity_rows, select_items, select_answers, select_pool, produce_items, produce_modes, lesson_rows, voice_rows, voice_lookup, block_ranges, outline, lint_codes, lint_rows)}
