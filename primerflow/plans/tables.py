"""Queries of text functions, assets, drift, dictionaries, catalogues and books over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assets as A
from ..operators import catalog as C
from ..operators import figures as G
from ..operators import timeline as L
from ..sources import sinks as K
from . import render as R

s = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")


def slugs(spark, d):
    """Slugs and file titles of part names."""
    name = F.concat(F.lit(" #"), F.initcap("p_name"), F.lit(" / "), F.col("p_brand"))
    return R.table(spark, d, "part").select("p_partkey", T.slug(name).alias("slug"), T.file_title(name).alias("title"))


def numbers(spark, d):
    """Padded numbers, ordinals, item numbers, numbers in file names."""
    n = F.col("p_partkey") % 130
    words = F.when(n % 26 < 24, F.concat(F.lit("Number "), F.element_at(F.array(*map(F.lit, [*T.NUMBER_WORDS, "x", "x"])), (n % 26 + 1).cast("int")), F.lit(", yes"))).otherwise(F.concat(F.lit("Number "), n.cast("string")))
    return R.table(spark, d, "part").select("p_partkey", T.padded(n * 11).alias("padded"), T.ordinal(n).alias("ordinal"), T.item_number(words).alias("item"), T.last_number(F.concat(F.lit("page7_"), n.cast("string"), F.lit(".png"))).alias("last"))


def peeled_assets(spark, d):
    """Tokens peeled from the ends of lines (P04) and counted."""
    k = s("p_partkey")
    line = F.concat(F.col("p_name"), F.lit(" {a"), k, F.lit(".mp3@1-2}"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" {b"), k, F.lit(".JPG}"))).otherwise(""), F.when(F.col("p_partkey") % 5 == 0, " {c.mp3}").otherwise(""))
    rows = R.table(spark, d, "part").select("p_partkey", T.peel(line).alias("p"), T.asset_facts(line).alias("f"))
    return rows.select("p_partkey", "p.text", "p.audio", "p.image", "f.total", "f.trailing", F.col("f.audio").alias("n_audio"), F.col("f.image").alias("n_image"))


def clip_names(spark, d):
    """Clip names made and read again (P23, P49), with their cache keys."""
    base = T.clip_base(F.col("p_size"), F.concat((F.col("p_partkey") % 9 + 1).cast("string"), F.lit("A")), F.col("p_partkey") % 7)
    parts = T.clip_parts(F.concat(base, F.lit("-q1.mp3")))
    return R.table(spark, d, "part").select("p_partkey", base.alias("base"), parts["lesson"].alias("lesson"), parts["fig"].alias("fig"), T.cache_key(F.col("p_name"), F.col("p_brand")).alias("key"))


def spoken_lines(spark, d):
    """What lines say (P24), as words (P25)."""
    k = F.col("p_partkey") % 4
    line = F.concat(F.when(k == 0, "PROMPT: ").when(k == 1, "OPTION: a | ").when(k == 2, "Bob: ").otherwise(""), F.col("p_name"), F.lit(" at 6:30 or 700, 5 times {x.mp3}"))
    said = T.spoken(line)
    return R.table(spark, d, "part").select("p_partkey", said.alias("said"), F.array_join(T.spoken_tokens(said), " ").alias("words"), T.token_key(F.col("p_brand")).alias("token"))


def escaped_pages(spark, d):
    """Pages escaped for HTML (P42), and paths of their links."""
    return R.table(spark, d, "pages").select("page_id", F.md5(T.escape_html(F.col("html"))).alias("escaped"), T.asset_path(F.concat(F.lit("../"), s("page_id"), F.lit(".png"))).alias("path"))


def link_counts(spark, d):
    """Links and paragraphs of pages."""
    return R.table(spark, d, "pages").select("page_id", T.occurrences(F.col("html"), "<a href=").alias("links"), T.occurrences(F.col("html"), "<p[ >]").alias("paragraphs"))


def squeezed(spark, d):
    """Documents with white space squeezed (P20) and the time to read them."""
    text = T.squeeze(F.col("text"))
    return R.table(spark, d, "documents").select("doc_id", F.md5(text).alias("squeezed"), T.nearest(T.read_seconds(F.col("text")), 2).alias("seconds"))


def sections(spark, d):
    """Documents cut at marker lines put after every fifth line."""
    marked = F.array_join(F.transform(F.split("text", "\n"), lambda x, k: F.when(k % 5 == 4, F.concat(x, F.lit("\n=== split ==="))).otherwise(x)), "\n")
    parts = T.split_sections(marked, r"\s*=== split ===\s*")
    return R.table(spark, d, "documents").select("doc_id", F.size(parts).alias("n_parts"), F.md5(F.array_join(parts, "|")).alias("parts"))


def image_refs(spark, d):
    """References rendered from line items and read again, by page."""
    ref = F.concat(F.lit("![[#"), s(F.col("l_quantity").cast("int")), F.lit(" a part]](images/page_"), s("l_orderkey"), F.lit("_"), s("l_linenumber"), F.lit(".png))"))
    lines = R.table(spark, d, "lineitem").select(ref.alias("raw"))
    found = lines.select(F.explode(T.image_refs(F.col("raw"))).alias("r")).select("r.*")
    return G.by_page(found)


def page_neighbours(spark, d):
    """Pages before and after each page with images, by customer."""
    return G.neighbours(G.pages_with_images(R.table(spark, d, "orders"), "o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


def crop_boxes(spark, d):
    """Pixel regions of boxes."""
    k = F.col("p_partkey")
    box = F.array(k % 900, k % 700, k % 900 + k % 101, k % 700 + 50)
    r = T.box_region(box, F.lit(1240), F.lit(1754), 0.15)
    return R.table(spark, d, "part").select("p_partkey", *[r[c].cast("long").alias(c) for c in "xywh"])


def versions(spark, d):
    """Versions compared in order (P46), language names."""
    k = F.col("p_partkey")
    a = F.concat(F.lit("v1."), (k % 12).cast("string"))
    b = F.concat(F.lit("1.7."), (k % 3).cast("string"))
    return R.table(spark, d, "part").select("p_partkey", C.compared(a, b).alias("order"), T.language_name(F.when(k % 2 == 0, "fr").otherwise("xx")).alias("language"))


def language_counts(spark, d):
    return R.table(spark, d, "documents").groupBy(T.language_name(F.col("lang")).alias("language")).agg(F.count("*").alias("n"))


def model_answers(spark, d):
    """Fenced arrays taken from answers and their lengths."""
    answer = F.concat(F.lit("```json\n["), F.array_join(F.transform(F.sequence(F.lit(1), (F.col("p_partkey") % 4 + 1).cast("int")), lambda x: x.cast("string")), ","), F.lit("]\n```"))
    rows = R.table(spark, d, "part").select("p_partkey", F.from_json(T.json_span(T.strip_fence(answer)), "array<int>").alias("b"), F.sequence(F.lit(1), (F.col("p_partkey") % 3 + 1).cast("int")).alias("a"))
    out = A.zipped(rows.select("p_partkey", "a"), rows.select("p_partkey", "b"), ["p_partkey"])
    return out.select("p_partkey", "ok", F.size("pairs").alias("n"))


def asset_counts(spark, d):
    """References of suppliers to part images, and how many are missing."""
    lines = R.table(spark, d, "lineitem").select(s("l_suppkey").alias("doc"), F.concat(F.lit("x {p"), s("l_partkey"), F.lit(".png} {q}")).alias("raw"))
    have = R.table(spark, d, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("p"), s("p_partkey"), F.lit(".png")).alias("name"))
    return A.missing_counts(A.references(lines), have)


def existing_assets(spark, d):
    """The first place at which a part's image exists."""
    k = F.col("p_partkey")
    names = R.table(spark, d, "part").select(F.concat(F.lit("p"), s("p_partkey"), F.lit(".png")).alias("name"))
    path = lambda folder, x: F.concat(F.lit(folder), F.lit("p"), s("p_partkey"), F.lit(x))
    listing = R.table(spark, d, "part").select(F.explode(F.array_compact(F.array(F.when(k % 2 == 0, path("", ".jpg")), F.when(k % 3 == 0, path("img/", ".png")), F.when(k % 5 == 0, path("", ".png"))))).alias("path"))
    return A.first_existing(names, listing, ["", "img/"], [".png", ".jpg"])


def drifted(spark, d):
    """Documents against a changed copy."""
    docs = R.table(spark, d, "documents").select(s("doc_id").alias("name"), "text", "doc_id")
    ours = docs.where("doc_id % 7 <> 0").select("name", F.col("text").alias("content"))
    theirs = docs.where("doc_id % 5 <> 0").select("name", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    return A.drift(ours, theirs).groupBy("state").agg(F.count("*").alias("n"))


def untranslated(spark, d):
    """Lines of documents that no benchmark line translates."""
    lines = R.table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    done = R.table(spark, d, "benchmark").select(F.explode(F.split("text", "\n")).alias("en")).distinct()
    return A.to_translate(lines, ["line"], done).agg(F.count("*").alias("n"), F.sum(F.length("en")).alias("chars"))


def dictionary(spark, d):
    """Part types with an entry of the dictionary, or none."""
    words = R.table(spark, d, "part").select("p_type").distinct().where("p_type < 'M'").select(F.col("p_type").alias("en"), F.lower("p_type").alias("other"))
    return A.translated(R.table(spark, d, "part").select("p_partkey", "p_type"), "p_type", words)


def pending_outputs(spark, d):
    """Documents without an output of the same producer."""
    docs = R.table(spark, d, "documents").select("doc_id", F.lit("v2").alias("producer"))
    made = R.table(spark, d, "labels").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "v2").otherwise("v1").alias("producer"))
    return A.pending(docs, made, ["doc_id", "producer"]).select("doc_id")


def _repos(spark, d):
    cust = R.table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_mktsegment", "c_acctbal")
    name = F.concat(F.lit("course"), (F.col("c_custkey") % 40).cast("string"))
    owner = F.concat(F.lit("n"), s("c_nationkey"))
    return cust.select(owner.alias("owner"), name.alias("name"), F.concat_ws("/", owner, name).alias("full_name"), "c_custkey", "c_acctbal").dropDuplicates(["full_name"])


def repo_sections(spark, d):
    """Lists of repositories without each other's (J12), counted with one's own list kept."""
    repos = _repos(spark, d).select("owner", "name", "full_name")
    mine, official = repos.where("owner = 'n3'"), repos.where("owner IN ('n3', 'n7')")
    return C.section_counts(C.sections(mine, official, repos.where("owner <> 'n5'"), "n3"))


def repo_status(spark, d):
    """Status of each order's copy: its clone is looked up by bare name."""
    o = R.table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("name"))
    local = R.table(spark, d, "part").where("p_partkey < 40").select(F.col("p_partkey").alias("name"), (F.col("p_partkey") % 3).alias("ahead"), (F.col("p_partkey") % 4).alias("behind"), (F.col("p_partkey") % 5 == 0).alias("changed"))
    rows = C.with_local(o, local)
    state = C.status(F.col("cloned"), F.col("ahead"), F.col("behind"), F.col("changed"))
    return rows.groupBy(state.alias("status")).agg(F.count("*").alias("n"))


def newest_orders(spark, d):
    """The fifty newest."""
    orders = R.table(spark, d, "orders").select(F.col("o_orderdate").alias("updated_at"), F.lpad(s("o_orderkey"), 9, "0").alias("full_name"))
    return C.newest(orders).select("full_name")


def lesson_texts(spark, d):
    """Documents as the files of books, a book for each hundred ids of a source: a heading in every third file, back matter
    in the last tenth of the files (W02, A05)."""
    docs = R.table(spark, d, "documents").withColumn("book", F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 100).cast("string")))
    own = Window.partitionBy("book")
    files = docs.select("book", F.row_number().over(own.orderBy("doc_id")).alias("file"), F.ceil(F.count("*").over(own) * 0.9).alias("back"), "text")
    head = F.when(F.col("file") == F.col("back") + 1, "APPENDIX").when(F.col("file") % 3 == 2, F.concat(F.lit("Lesson "), F.col("file").cast("string"), F.lit("A"))).otherwise("plain")
    lines = files.select("book", "file", F.posexplode(F.array(head, F.md5("text"))).alias("ln", "raw"))
    return C.lesson_lines(lines, r"^Lesson (\d+A)$", "^APPENDIX$").select("book", "lesson", "n_lines", F.md5("text").alias("text"))


def book_and_tape(spark, d):
    """Lessons of a book without a tape, and the reverse."""
    book = R.table(spark, d, "part").select((F.col("p_partkey") % 97).alias("code")).distinct()
    tape = R.table(spark, d, "supplier").select((F.col("s_suppkey") % 89 + 20).alias("code")).distinct()
    return C.sided(book, tape, "code")


def error_kinds(spark, d):
    """Kinds of errors (P33), waits of three attempts."""
    messages = F.element_at(F.array(*map(F.lit, ("429 too many", "fetch failed", "RESOURCE_EXHAUSTED", "bad input", "socket hang up"))), (F.col("event_id") % 5 + 1).cast("int"))
    rows = R.table(spark, d, "events").where("event_type = 'error'").select(C.error_kind(messages).alias("kind"), (F.col("event_id") % 3 + 1).cast("int").alias("attempt"))
    return C.retry_schedule(rows).groupBy("kind", "attempt", "seconds").agg(F.count("*").alias("n"))


def batches(spark, d):
    """Orders of a customer's book in batches of forty: a book for each two hundred customers."""
    orders = R.table(spark, d, "orders").select(F.floor(F.col("o_custkey") / 200).alias("book"), "o_orderkey")
    return L.batched(orders, ["book"], "o_orderkey").groupBy("book", "batch").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


def distinct_names(spark, d):
    """Union of distinct names of suppliers and customers."""
    a = R.table(spark, d, "supplier").select((F.col("s_suppkey") % 50).alias("k"))
    return A.distinct_union(a, R.table(spark, d, "customer").select((F.col("c_custkey") % 70).alias("k")))


def combined_chunks(spark, d):
    """Turns of conversations as the chunks of a book, joined in order; every fourth has failed and leaves a hole."""
    turns = R.table(spark, d, "conversations")
    chunks = turns.select(F.col("conv_id").alias("book"), F.col("turn").alias("start"), F.when(F.col("turn") % 4 != 3, F.col("text")).alias("text"))
    return K.combine(chunks).select("book", F.md5("text").alias("joined"), F.array_join("missing", ",").alias("holes"))


_SQ = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
SQL = {
    "slugs": "WITH n AS (SELECT p_partkey, p_name, p_brand, list_aggregate(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), 'string_agg', ' ') AS t FROM part) SELECT p_partkey, replace(p_name, ' ', '-') || '-' || replace(lower(p_brand), '#', '-') AS slug, t || ' ' || replace(p_brand, '#', '') AS title FROM n",
    "numbers": f"""
SELECT p_partkey, CASE WHEN n * 11 > 999 THEN CAST(n * 11 AS VARCHAR) ELSE lpad(CAST(n * 11 AS VARCHAR), 3, '0') END AS padded,
 n || CASE WHEN n % 100 BETWEEN 11 AND 13 THEN 'th' WHEN n % 10 = 1 THEN 'st' WHEN n % 10 = 2 THEN 'nd' WHEN n % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal,
 CAST(CASE WHEN n % 26 < 24 THEN n % 26 + 1 ELSE n END AS INT) AS item, CAST(n AS INT) AS last FROM (SELECT p_partkey, p_partkey % 130 AS n FROM part)""",
    "peeled_assets": """
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 AND p_partkey % 3 = 0 THEN p_name || ' {a' || p_partkey || '.mp3@1-2}' WHEN p_partkey % 5 = 0 THEN p_name || ' {a' || p_partkey || '.mp3@1-2}' ELSE p_name END AS text,
 CASE WHEN p_partkey % 5 = 0 THEN 'c.mp3' ELSE 'a' || p_partkey || '.mp3' END AS audio, CASE WHEN p_partkey % 3 = 0 THEN 'b' || p_partkey || '.JPG' END AS image,
 CAST(1 + (p_partkey % 3 = 0)::INT + (p_partkey % 5 = 0)::INT AS INT) AS total, CAST(1 + (p_partkey % 3 = 0)::INT + (p_partkey % 5 = 0)::INT AS INT) AS trailing, CAST(1 + (p_partkey % 5 = 0)::INT AS INT) AS n_audio, CAST((p_partkey % 3 = 0)::INT AS INT) AS n_image FROM part""",
    "clip_names": "SELECT p_partkey, 'bk' || p_size || '-l' || (p_partkey % 9 + 1) || 'a-f' || p_partkey % 7 AS base, (p_partkey % 9 + 1) || 'A' AS lesson, CAST(p_partkey % 7 AS INT) AS fig, left(sha1(p_name || '|' || p_brand), 12) AS key FROM part",
    "spoken_lines": "SELECT p_partkey, p_name || ' at 6:30 or 700, 5 times' AS said, p_name || ' at six thirty or seven o''clock five times' AS words, replace(lower(p_brand), '#', '') AS token FROM part",
    "escaped_pages": """SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped, 'module/' || page_id || '.png' AS path FROM pages""",
    "link_counts": "SELECT page_id, CAST(len(regexp_extract_all(html, '<a href=')) AS INT) AS links, CAST(len(regexp_extract_all(html, '<p[ >]')) AS INT) AS paragraphs FROM pages",
    "squeezed": rf"SELECT doc_id, md5({_SQ}) AS squeezed, floor(greatest(2.2, least(1.2 + len(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '')) * 0.32, 8.0)) * 100 + 0.5) / 100 AS seconds FROM documents",
    "sections": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
p AS (SELECT doc_id, (k - 1) // 5 AS part, regexp_replace(string_agg(line, chr(10) ORDER BY k), '^\s+|\s+$', '', 'g') AS t FROM l GROUP BY ALL)
SELECT d.doc_id, CAST(count(part) AS INT) AS n_parts, md5(coalesce(string_agg(t, '|' ORDER BY part), '')) AS parts FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id AND t <> '' GROUP BY d.doc_id""",
    "image_refs": "SELECT CAST(l_orderkey AS INT) AS page, count(*) AS n, max(l_linenumber) AS idx, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS panels, 'a part' AS caption FROM lineitem GROUP BY l_orderkey",
    "page_neighbours": "SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "crop_boxes": """
WITH b AS (SELECT p_partkey, p_partkey % 900 AS y0, p_partkey % 700 AS x0, p_partkey % 900 + p_partkey % 101 AS y1, p_partkey % 700 + 50 AS x1 FROM part),
e AS (SELECT p_partkey, greatest(0.0, least((x0 + x1) / 2 - ((x1 - x0) * 1.15::DOUBLE) / 2, 1000.0)) AS xa, greatest(0.0, least((x0 + x1) / 2 + ((x1 - x0) * 1.15::DOUBLE) / 2, 1000.0)) AS xb,
 greatest(0.0, least((y0 + y1) / 2 - ((y1 - y0) * 1.15::DOUBLE) / 2, 1000.0)) AS ya, greatest(0.0, least((y0 + y1) / 2 + ((y1 - y0) * 1.15::DOUBLE) / 2, 1000.0)) AS yb FROM b),
r AS (SELECT p_partkey, floor(xa / 1000 * 1240 + 0.5) AS x, floor(ya / 1000 * 1754 + 0.5) AS y, floor((xb - xa) / 1000 * 1240 + 0.5) AS w, floor((yb - ya) / 1000 * 1754 + 0.5) AS h FROM e)
SELECT p_partkey, CASE WHEN w > 0 AND h > 0 THEN CAST(x AS BIGINT) END AS x, CASE WHEN w > 0 AND h > 0 THEN CAST(y AS BIGINT) END AS y, CASE WHEN w > 0 AND h > 0 THEN CAST(w AS BIGINT) END AS w, CASE WHEN w > 0 AND h > 0 THEN CAST(h AS BIGINT) END AS h FROM r""",
    "versions": "SELECT p_partkey, CAST(CASE WHEN p_partkey % 12 < 7 THEN -1 WHEN p_partkey % 12 > 7 THEN 1 WHEN p_partkey % 3 > 0 THEN -1 ELSE 0 END AS INT) AS \"order\", CASE WHEN p_partkey % 2 = 0 THEN 'French' ELSE 'xx' END AS language FROM part",
    "language_counts": "SELECT CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' ELSE lang END AS language, count(*) AS n FROM documents GROUP BY 1",
    "model_answers": "SELECT p_partkey, p_partkey % 4 = p_partkey % 3 AS ok, CASE WHEN p_partkey % 4 = p_partkey % 3 THEN CAST(p_partkey % 3 + 1 AS INT) END AS n FROM part",
    "asset_counts": "SELECT CAST(l_suppkey AS VARCHAR) AS doc, count(*) AS n FROM lineitem WHERE l_partkey % 3 <> 0 OR l_partkey NOT IN (SELECT p_partkey FROM part) GROUP BY l_suppkey",
    "existing_assets": "SELECT 'p' || p_partkey || '.png' AS name, CASE WHEN p_partkey % 5 = 0 THEN 'p' || p_partkey || '.png' WHEN p_partkey % 2 = 0 THEN 'p' || p_partkey || '.jpg' ELSE 'img/p' || p_partkey || '.png' END AS path FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0 OR p_partkey % 5 = 0",
    "drifted": "SELECT CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'extra' WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'same' END AS state, count(*) AS n FROM documents WHERE doc_id % 35 <> 0 GROUP BY 1",
    "untranslated": "WITH l AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS en FROM documents), b AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS en FROM benchmark) SELECT count(*) AS n, CAST(sum(length(en)) AS BIGINT) AS chars FROM l WHERE en <> '' AND en NOT IN (SELECT en FROM b)",
    "dictionary": "SELECT p_partkey, p_type, CASE WHEN p_type < 'M' THEN lower(p_type) END AS other FROM part",
    "pending_outputs": "SELECT doc_id FROM documents WHERE NOT (doc_id % 2 = 0 AND doc_id IN (SELECT doc_id FROM labels))",
    "repo_sections": """
WITH r AS (SELECT DISTINCT 'n' || c_nationkey AS owner, 'n' || c_nationkey || '/course' || c_custkey % 40 AS full_name FROM customer)
SELECT CASE owner WHEN 'n3' THEN 'mine' WHEN 'n7' THEN 'official' ELSE 'community' END AS section, count(*) AS n FROM r WHERE owner <> 'n5' GROUP BY 1""",
    "repo_status": """
SELECT CASE WHEN k >= 40 THEN 'remote' WHEN k % 4 > 0 AND k % 5 = 0 THEN 'conflict' WHEN k % 4 > 0 THEN 'behind' WHEN k % 5 = 0 OR k % 3 > 0 THEN 'dirty' ELSE 'clean' END AS status, count(*) AS n
FROM (SELECT o_custkey % 50 AS k FROM orders) GROUP BY 1""",
    "newest_orders": "SELECT lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS full_name FROM orders ORDER BY o_orderdate DESC, full_name LIMIT 50",
    "lesson_texts": """
WITH b AS (SELECT source || '-' || doc_id // 100 AS source, doc_id, text FROM documents),
f AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS file, ceil(count(*) OVER (PARTITION BY source) * 0.9) AS back, md5(text) AS h FROM b),
k AS (SELECT source, file, h, CASE WHEN file % 3 = 2 THEN 'Lesson ' || file || 'A' ELSE 'plain' END AS head, CASE WHEN file % 3 = 2 THEN file WHEN file % 3 = 0 THEN file - 1 ELSE file - 2 END AS lesson FROM f WHERE file <= back AND file >= 2)
SELECT source AS book, lesson || 'A' AS lesson, count(*) * 2 AS n_lines, md5(string_agg(head || chr(10) || h, chr(10) ORDER BY file)) AS text FROM k GROUP BY source, lesson""",
    "book_and_tape": "WITH b AS (SELECT DISTINCT p_partkey % 97 AS code FROM part), t AS (SELECT DISTINCT s_suppkey % 89 + 20 AS code FROM supplier) SELECT coalesce(b.code, t.code) AS code, CASE WHEN t.code IS NULL THEN 'book' WHEN b.code IS NULL THEN 'tape' ELSE 'both' END AS side FROM b FULL JOIN t ON b.code = t.code",
    "error_kinds": """
SELECT ['rate','network','rate','other','network'][event_id % 5 + 1] AS kind, CAST(event_id % 3 + 1 AS INT) AS attempt, CASE WHEN event_id % 3 < 2 THEN 2.0::DOUBLE * pow(2.0, event_id % 3) END AS seconds, count(*) AS n
FROM events WHERE event_type = 'error' GROUP BY ALL""",
    "batches": "SELECT book, CAST((n - 1) // 40 AS BIGINT) AS batch, count(*) AS n, min(o_orderkey) AS first FROM (SELECT CAST(o_custkey // 200 AS BIGINT) AS book, o_orderkey, row_number() OVER (PARTITION BY o_custkey // 200 ORDER BY o_orderkey) AS n FROM orders) GROUP BY book, (n - 1) // 40",
    "distinct_names": "SELECT s_suppkey % 50 AS k FROM supplier UNION SELECT c_custkey % 70 FROM customer",
    "combined_chunks": "SELECT conv_id AS book, md5(coalesce(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn, text) FILTER (turn % 4 <> 3), '')) AS joined, coalesce(string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) FILTER (turn % 4 = 3), '') AS holes FROM conversations GROUP BY conv_id",
}
_FUNCTIONS = (slugs, numbers, peeled_assets, clip_names, spoken_lines, escaped_pages, link_counts, squeezed, sections, image_refs, page_neighbours, crop_boxes, versions, language_counts, model_answers, asset_counts, existing_assets, drifted, untranslated, dictionary, pending_outputs, repo_sections, repo_status, newest_orders, lesson_texts, book_and_tape, error_kinds, batches, distinct_names, combined_chunks)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
