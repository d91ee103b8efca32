"""Speech, timeline, sources, sinks, validators and streams on small cases."""

import json
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from primerflow.functions import text as T
from primerflow.operators import figures as G
from primerflow.operators import speech as S
from primerflow.operators import validate as V
from primerflow.plans import speech
from primerflow.sources import files, sinks
from primerflow.sources.module_source import read_modules
from primerflow.streaming import lint_stream
from primerflow.streaming.lint_stream import gap_sessions
from pyspark.sql import functions as F


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_alignment_properties(a, b):
    pairs = S.lcs_pairs(a, b)
    assert len(pairs) == plain_lcs(a, b) == len(S.lcs_pairs(b, a))
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(S.lcs_pairs(a[:-1], b)) <= len(pairs)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=40), st.lists(st.sampled_from("abcd"), max_size=40))
def test_alignment_takes_the_way_of_the_whole_table(a, b):
    table, i, j, want = np.zeros((len(a) + 1, len(b) + 1), int), 0, 0, []
    for p in range(len(a) - 1, -1, -1):
        for q in range(len(b) - 1, -1, -1):
            table[p, q] = table[p + 1, q + 1] + 1 if a[p] == b[q] else max(table[p + 1, q], table[p, q + 1])
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            want.append((i, j))
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            i += 1
        else:
            j += 1
    assert S.lcs_pairs(a, b) == want


def test_long_texts_align_in_little_time_and_memory(monkeypatch):
    a = [f"w{k * k % 977}" for k in range(20_000)]
    b = [w for k, w in enumerate(a) if k % 5 != 4]
    began = time.time()
    pairs = S.lcs_pairs(a, b)
    assert len(pairs) == len(b) and pairs[0] == (0, 0) and time.time() - began < 30
    monkeypatch.setattr(S._Rows, "KEEP", 0)
    assert S.lcs_pairs(a[:500], b[:400]) == S.lcs_pairs(a[:500], b[:400]) and len(S.lcs_pairs(a[:500], b[:400])) == 400


def test_sessions_of_a_stream(spark, tmp_path):
    """Pauses cut a stream's words into sessions, as they cut a table's."""
    rows = [("a", 0.0), ("a", 1.0), ("a", 3.0), ("b", 0.5), ("a", 100.0)]
    words = spark.createDataFrame(rows, "k string, t double").select("k", F.timestamp_seconds("t").alias("at"))
    words.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(words.schema).parquet(f"{tmp_path}/in")
    query = gap_sessions(stream, ["k"]).writeStream.format("memory").queryName("gaps").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    closed = {(r.k, r.n) for r in spark.table("gaps").collect()}  # the last one is still open
    assert closed == {("a", 2), ("a", 1), ("b", 1)} and {(r.k, r.n) for r in gap_sessions(words, ["k"]).collect()} == closed


def test_file_sources_and_error_output(spark, tmp_path):
    """Folders of texts, a missing one, and rows with errors beside the others; a rerun replaces both."""
    (tmp_path / "books").mkdir()
    for name in ("b.md", "a.md", "c.txt"):
        (tmp_path / "books" / name).write_text(f"text of {name}\r\nend")
    assert sorted((r.doc, r.text) for r in files.texts(spark, str(tmp_path / "books"), "*.md").collect()) == [("a.md", "text of a.md\r\nend"), ("b.md", "text of b.md\r\nend")]
    assert files.texts(spark, str(tmp_path / "none")).count() == 0 and files.listing(spark, str(tmp_path / "books")).count() == 3
    rows = spark.createDataFrame([("a", "x", None), ("b", None, "boom")], "doc string, text string, error string")
    for _ in range(2):
        sinks.write_with_errors(rows, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/ok")).count() == spark.read.parquet(str(tmp_path / "out/error")).count() == 1


def test_manifest_versions_are_new_folders(spark, tmp_path):
    rows = spark.createDataFrame([(1, "yes", None), (2, "no", "old")], "seg int, en string, ru string")
    done = spark.createDataFrame([("yes", "da"), ("no", "")], "en string, other string")
    out = sinks.updated_manifest(rows, done, str(tmp_path / "v2"))
    assert sorted((r.seg, r.ru) for r in spark.read.parquet(str(tmp_path / "v2")).collect()) == [(1, "da"), (2, "old")] and out.columns == rows.columns
    with pytest.raises(Exception, match="already exists"):
        sinks.updated_manifest(rows, done, str(tmp_path / "v2"))


def test_whole_texts_are_aligned(spark, tmp_path):
    texts = [(n, " ".join(f"w{k * k % 97}" for k in range(n))) for n in (1, 60, 61, 900)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.id: r.n_pairs for r in speech.aligned(spark, str(tmp_path)).collect()} == {n: n - n // 5 for n, _ in texts}


def test_align_rows(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], ["x", "a", "b"]), (2, [], ["a"]), (3, None, None)], "id long, a array<string>, b array<string>")
    out = {r.id: r for r in S.chosen_span(S.align(rows)).collect()}
    assert (out[1].n_pairs, out[1].first_b, out[1].last_b, out[1].span) == (2, 1, 2, "segment")
    assert out[2].n_pairs == out[3].n_pairs == 0 and out[2].span is None


def test_gaps_share_their_time(spark):
    rows = spark.createDataFrame([(0, None, None), (1, 1.0, 2.0), (2, None, None), (3, None, None), (4, 5.0, 6.0), (5, None, None)], "pos int, start double, end double").withColumn("k", F.lit(1))
    out = [(r.start, r.end) for r in S.fill_gaps(rows, ["k"]).orderBy("pos").collect()]
    assert out == [(1.0, 1.0), (1.0, 2.0), (2.0, 5.0), (5.0, 5.0), (5.0, 6.0), (6.0, 6.0)]


def test_utterances_break_late_and_after_stops(spark):
    rows = spark.createDataFrame([(1, "a", 0.0, 1.0), (2, "b.", 2.5, 3.0), (3, "c", 3.0, 4.0), (4, "d", 5.6, 6.0)], "word_no int, word string, start double, end double").withColumn("k", F.lit(1))
    assert [r.text for r in S.utterances(rows, ["k"]).orderBy("utterance").collect()] == ["a b.", "c", "d"]


def test_spoken_tokens(spark):
    say = lambda s: spark.createDataFrame([(s,)], "s string").select(T.spoken_tokens(F.col("s")).alias("t")).first().t
    assert say("At 6:30, 100 or 1945; 7 'it's' 21") == ["at", "six", "thirty", "one", "o'clock", "or", "nineteen", "forty", "five", "seven", "it's", "twenty", "one"]
    assert say("") == []


def test_rounding_and_trim(spark):
    row = spark.createDataFrame([(-2.5, "  x\t")], "n double, s string").select(T.nearest(F.col("n")).alias("n"), T.trim(F.col("s")).alias("s"), T.padded(F.lit(12345)).alias("p"), T.slug(F.lit("Ça va? Oui!")).alias("g")).first()
    assert (row.n, row.s, row.p, row.g) == (-2, "x", "12345", "a-va-oui")


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.module").write_bytes(b"$MODULE x\r\nTITLE: y\n")
    (tmp_path / "b c.md").write_text("# x")
    (tmp_path / "b.md.Zone.Identifier").write_text("")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/t.json").write_text(json.dumps({"info": {"source": "s"}, "segments": [{"id": 1, "words": [{"word": "hi", "start": 1.0, "end": 2.0}]}]}))
    path = f"file://{tmp_path}"
    assert [(r.doc, r.text) for r in files.texts(spark, path, "*.module").collect()] == [("a.module", "$MODULE x\r\nTITLE: y\n")]
    assert files.texts(spark, path + "/none").count() == 0 and files.listing(spark, path + "/none").count() == 0
    assert {r.doc for r in files.markdown_inputs(files.texts(spark, path)).collect()} == {"b c.md"}
    assert {r.name for r in files.listing(spark, path).collect()} >= {"a.module", "t.json"}
    assert [tuple(r) for r in files.transcripts(spark, path + "/sub").collect()] == [("t.json", 0, 0, "hi", 1.0, 2.0)]
    rows = read_modules(spark, path).orderBy("ln").collect()
    assert [(r.doc, r.ln, r.raw) for r in rows] == [("a.module", 1, "$MODULE x\r"), ("a.module", 2, "TITLE: y"), ("a.module", 3, "")]


def test_default_rules(spark):
    row = spark.createDataFrame([(0.0, None)], "t double, u double").select(files.or_default(F.col("t"), 1.0).alias("a"), files.or_default(F.col("t"), 1.0, "falsy").alias("b"), files.or_default(F.col("u"), 1.0, "kept").alias("c")).first()
    assert tuple(row) == (0.0, 1.0, None)


def test_book_and_script(spark):
    text = "# UNIT\n# THE LESSON 1A\n## Figure 2\n**Say it.**\n**More**\n1. ![#3 a cat](i/c.png)\n2. plain\n# LESSON 1B\n## Figure 9\n"
    row = files.lesson_book(spark.createDataFrame([("b", text)], "doc string, text string")).collect()
    assert len(row) == 1 and (row[0].fig, row[0].instruction) == (2, "Say it.")
    assert [(i["index"], i.image and (i.image.path, i.image.panel, i.image.caption), i.text) for i in row[0]["items"]] == [(1, ("i/c.png", 3, "a cat"), None), (2, None, "plain")]
    script = "## Lesson 1A\nAUDIO TRACK 1\nintro\nAUDIO TRACK 2\nFigure 3 one\nAUDIO TRACK 3\ntwo\nEND OF LESSON 1A\nFigure 8"
    rows = spark.createDataFrame([(2, "# Lesson 1A\nno"), (1, "x"), (3, script)], "file_order int, text string")
    assert [(r.fig, r.text) for r in files.tape_scripts(rows, "1A").collect()] == [(3, "Figure 3 one\n\ntwo")]


def test_sinks(spark, tmp_path):
    chunks = spark.createDataFrame([("b", 7, None), ("b", 1, "one"), ("b", 13, "two")], "book string, start int, text string")
    row = sinks.combine(chunks).first()
    assert row.text == "one\n\n---\n\ntwo" and row.missing == [7]
    docs = spark.createDataFrame([("d", "intro\n@@\n# One/Two\nx\n@@\n")], "doc string, text string")
    none = spark.createDataFrame([("d", "001.md")], "doc string, name string")
    assert [(r.name, r.text) for r in sinks.split_documents(docs, "@@", none).collect()] == [("002 - One Two.md", "# One/Two\nx")]
    lines = spark.createDataFrame([("d", 1, "a {x/p.jpg} {c.mp3@1.5-2}")], "doc string, ln int, raw string")
    assert sinks.sliced(lines).first().text == "a {p.jpg} {c.mp3}"
    rows = spark.createDataFrame([("a", None), ("b", "bad")], "doc string, error string")
    sinks.write_with_errors(rows, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out/error").first().doc == "b"


def test_validators(spark):
    docs = spark.createDataFrame([("d", "$MODULE x\n$SELECT a\nPROMPT: p\n$LESSON: y\nVOICE_SPEAKER: A b = K\n")], "doc string, text string")
    assert sorted(r.warning for r in V.module_warnings(docs).collect()) == ["colon", "label-spaces", "missing-doc-id", "missing-home-lang", "missing-target-lang", "select-without-answer"]
    subs = spark.createDataFrame([("t", 0, 0, 5, "a"), ("t", 1, 9, 9, "b"), ("t", 2, 8, 10, " ")], "tape string, pos int, begin int, end int, text string")
    assert [(r.pos, r.fault) for r in V.subtitle_faults(subs).orderBy("pos").collect()] == [(1, "order"), (2, "not monotonic")]
    truth = spark.createDataFrame([("m", 1, ["cat"], ["dog"]), ("m", 2, ["x"], [])], "model string, panel int, must array<string>, must_not array<string>")
    answers = spark.createDataFrame([("m", 1, "A Cat")], "model string, panel int, text string")
    assert tuple(V.keyword_scores(answers, truth, ["model"]).first()) == ("m", 1, 2)


def test_figures(spark):
    seg = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "fig int, item_number int")
    img = spark.createDataFrame([(1, 1, 0, "a"), (1, 1, 1, "b")], "fig int, idx int, pos int, path string")
    out = G.linked_images(seg, img, spark.createDataFrame([(1,)], "fig int"))
    assert sorted((r.fig, r.item_number, r.image or "") for r in out.collect()) == [(1, 1, "b"), (1, 2, "")]
    row = spark.range(1).select(G.display_mode(F.lit(0), F.lit("dictation")).alias("a"), G.display_mode(F.lit(2), F.lit("dictation")).alias("b"), G.public_path(F.lit(""), F.lit("x/y.png")).alias("c"), G.token_times(F.array(F.lit("a"), F.lit("b")), F.array(F.lit(0.0)), F.lit(0.0), F.lit(4.0)).alias("d")).first()
    assert tuple(row) == ("listen", "readAlong", "images/y.png", [0.0, 2.0])


def test_lint_stream(spark, tmp_path):
    source, target = tmp_path / "in", f"file://{tmp_path}/out"
    source.mkdir()
    (source / "a.module").write_text("no markers")
    for text in ("no markers", "$MODULE t"):
        (source / f"{len(list(source.iterdir()))}.module").write_text(text)
        lint_stream.lint_changes(lint_stream.watch_modules(spark, f"file://{source}"), target, f"file://{tmp_path}/ck").awaitTermination()
    found = lint_stream.newest(spark, target)
    assert {r.doc for r in found.where("code = 'no-sections'").collect()} == {"a.module", "1.module"}
    assert found.where("doc = '2.module' AND code = 'missing-target-lang'").count() == 1
