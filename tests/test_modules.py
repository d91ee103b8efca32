"""Module text: classes, context, items, voices and diagnostics."""

import pytest

from primerflow.functions import text as T
from primerflow.operators import figures
from primerflow.operators import module as M
from primerflow.operators.lint import lint, severity_counts
from primerflow.plans import speech
from pyspark.sql import functions as F

HEAD = "$MODULE Title {cover.jpg}\nFORMAT: 2\nDIOCO_DOC_ID: d\nTARGET_LANG_G: fr\nHOME_LANG_G: en\n"


def parsed(spark, text):
    return M.parse(spark.createDataFrame([("d", text)], "doc string, text string"))


def codes(spark, text):
    return [(r.code, r.line) for r in lint(spark.createDataFrame([("d", text)], "doc string, text string")).orderBy("seq").collect()]


def test_kinds_in_order(spark):
    text = "# c\n\n  # c\n$LESSON A\n REPEAT\nPROMPT: x\n PROMPT: y\n$5 off\nplain\n"
    rows = parsed(spark, text).orderBy("ln").collect()
    assert [r.kind for r in rows] == ["comment", "blank", "comment", "marker", "flag", "field", "raw", "marker", "raw", "blank"]
    assert rows[7].marker is None or rows[7].marker == "5"


def test_context_and_made_up_lesson(spark):
    rows = M.activities(parsed(spark, "$DIALOGUE\nA: x\n$LESSON L\nstray\n$CHAT C\nSCENARIO: s\n$DIALOGUE Two")).orderBy("ln").collect()
    assert [(r.lesson_no, r.act_no, r.type, r.title) for r in rows] == [(1, 1, "DIALOGUE", "Dialogue"), (2, 1, "CHAT", "C"), (2, 2, "DIALOGUE", "Two")]
    lessons = M.lessons(parsed(spark, "$DIALOGUE\n$LESSON\n")).orderBy("lesson_no").collect()
    assert [(r.id, r.title) for r in lessons] == [("default-lesson", "Default Lesson"), ("untitled", "Untitled Lesson")]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("hi {a.mp3} {p.jpg}", ("hi", "a.mp3", "p.jpg")), ("hi {p.PNG}{a.ogg@1-2}", ("hi", "a.ogg", "p.PNG")), ("hi {a.mp3} {b.mp3}", ("hi {a.mp3}", "b.mp3", None)),
        ("hi {x.txt}", ("hi {x.txt}", None, None)), ("{a.mp3}", ("", "a.mp3", None)), ("{a.mp3} tail", ("{a.mp3} tail", None, None)),
    ],
)
def test_peel(spark, line, want):
    row = spark.createDataFrame([(line,)], "s string").select(T.peel(F.col("s")).alias("p")).first().p
    assert (row.text, row.audio, row.image) == want


def test_dialogue_state(spark):
    text = HEAD + "$DIALOGUE T\nVOCAB: one\nVOCAB: two\nAnn: Hello {a.mp3}\nNOTES: n\nLINE: More {p.jpg}\nBob:\nLINE: said\nVOCAB: lost\nÉva: no"
    rows = M.dialogue_lines(parsed(spark, text)).orderBy("line_no").collect()
    assert [(r.speaker, r.text, r.notes, r.image, r.audio, r.vocab) for r in rows] == [
        ("Ann", "Hello", "n", None, "a.mp3", ["one", "two"]), ("Ann", "More", None, "p.jpg", None, None), ("Bob", "said", None, None, None, None),
    ]


def test_select_items(spark):
    text = HEAD + "$SELECT S\nOPTION: a | A\nOPTION: a | {a.png}\nbad\nEXAMPLE\nPROMPT: p1 {c.mp3}\nTEMPLATE: t1 {i.png}\nANSWER: a, b,\nOPTION: z | Z | z\nPROMPT: p2\nPROMPT: p3\nANSWER:\nTEMPLATE: t3\nFEEDBACK: f\nEXAMPLE\nTEMPLATE: t4"
    rows = M.numbered(parsed(spark, text), "SELECT")
    items = M.select_items(rows).orderBy("item_no").collect()
    assert [(r.prompt, r.template, r.answer, r.is_example, r.feedback) for r in items] == [("p1", "t1", ["a", "b"], True, None), ("p2", None, [], False, None), ("p3", "t3", [], False, "f"), (None, "t4", [], True, None)]
    assert (items[0].prompt_image, items[0].audio) == ("i.png", "c.mp3")
    options = M.select_options(rows)
    assert [(r.item_no, r.id, r.text, r.image) for r in options.orderBy("item_no", "pos").collect()] == [(0, "a", "A", "a.png"), (1, "z", "Z | z", None)]
    chosen = M.item_options(M.select_items(rows), options).orderBy("item_no").collect()
    assert [r.chosen and r.chosen.id for r in chosen] == [None, None, None, None] and [o.id for o in chosen[1].options] == ["a"]


def test_produce_items(spark):
    text = HEAD + "$PRODUCE P\nACCEPT: early\nPROMPT: p1\nRESPONSE:\nTEMPLATE: t2\nPROMPT: p2 {p.jpg}\nRESPONSE: r {r.mp3} {x.jpg}\nACCEPT: a | |b\nRUBRIC: ru"
    items = M.produce_items(M.numbered(parsed(spark, text), "PRODUCE")).orderBy("item_no").collect()
    assert [(r.prompt, r.template, r.response, r.response_audio, r.accept, r.rubric) for r in items] == [("p1", None, "", None, None, None), ("p2", "t2", "r {r.mp3} {x.jpg}", None, ["a", "b"], "ru")]


def test_grammar_keeps_blanks_and_drops_headings(spark):
    text = HEAD + "$GRAMMAR G\nINTRO: i\n# gone\nfirst\n\nNOTE: x\n$5 off\nlast"
    assert M.grammar(parsed(spark, text)).first().content == "first\n\nNOTE:x\nlast"


def test_header_voices_course(spark):
    row = M.header(parsed(spark, HEAD + "HOME_LANG_G: de\n$LESSON x\nTARGET_LANG_G: late")).first()
    assert (row.title, row.image, row.target_lang, row.home_lang, row.missing) == ("Title", "cover.jpg", "fr", "de", [])
    rows = M.voices(parsed(spark, HEAD + "VOICE: A | Puck | x | y\nVOICE: A | Leda\nVOICE_SPEAKER: B b = Kore | s\nVOICE_DEFAULT: Zephyr\nVOICE: bad")).collect()
    assert {(r.slot, r.speaker, r.voice, r.prompt) for r in rows} == {("speaker", "A", "Leda", None), ("speaker", "B b", "Kore", "s"), ("default", None, "Zephyr", None)}
    course = M.parse_course(spark.createDataFrame([("c", "# x\nTITLE: a\nTITLE: b: c\n\n: no")], "doc string, text string")).collect()
    assert [(r.key, r.value) for r in course] == [("TITLE", "b: c")]


CLEAN = HEAD + "\n$LESSON L\n$SELECT S\nOPTION: a | A\nPROMPT: p\nANSWER: a\n"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (CLEAN, []), ("", [("no-sections", 1), ("missing-module", 1)]), (CLEAN + "EXAMPLE\n", [("example-not-applied", 12)]), (CLEAN + "PROMPT: q\nANSWER: a", [("item-needs-blank-line", 12)]), (CLEAN + "\nPROMPT: q", [("select-missing-answer", 13)]),
        (CLEAN + "$SELECT S\n", [("dup-activity-id", 12)]), (CLEAN + "SPEAKER: x\nIMAGE: y", [("legacy-speaker-field", 12), ("legacy-image-field", 13)]), (CLEAN + "AUDIO_ONLY", [("legacy-audio-only", 12)]),
        (CLEAN + "$LESSON {x.jpg}", [("title-image-unsupported", 12)]), (CLEAN + "$DIALOGUE {x.mp3}", [("title-asset-invalid", 12)]), (CLEAN + "$NOPE", [("section-unknown", 12)]), (CLEAN + " $LESSON x", [("section-indent", 12), ("raw-content", 12)]),
        (CLEAN + "$PRODUCE P\nRESPONSE: r\nINPUT: either\nCHECK: x\nPROMPT: p {a.mp3} {b.mp3}\nTEMPLATE: {a.mp3}\nRESPONSE: {p.jpg}", [("response-before-stimulus", 13), ("input-invalid", 14), ("check-invalid", 15), ("multiple-inline-clips", 16), ("template-with-clip", 17), ("response-with-image", 18)]),
        ("FORMAT: 2\n$MODULE t\nFORMAT: 2\nTITLE: x\nVOICE_SPEAKER: a b = Puck\nVOICE_SPEAKER: A b = Puck\nVOICE: x\nDIOCO_DOC_ID: d\nTARGET_LANG_G: fr\nUSER_LANG_G: en\n$CHAT c", [("legacy-title-field", 4), ("voice-format", 7), ("dup-header-field", 3), ("voice_speaker-deprecated", 5), ("voice_speaker-label", 5), ("voice_speaker-deprecated", 6), ("voice_speaker-label", 6), ("voice_speaker-dup", 6), ("voice_speaker-case", 6), ("implicit-lesson", 11)]),
        (CLEAN + "$LESSON M\nFORMAT: 2\nstray", [("field-outside-activity", 13), ("content-outside", 14)]), (CLEAN + "$GRAMMAR G\nREPEAT\nMULTI\nSHOW_PROMPT\nEXAMPLE\nFOO: x", [("repeat-outside-dialogue", 13), ("flag-outside-select", 14), ("flag-outside-show-prompt", 15), ("example-outside-item", 16), ("field-unexpected", 17), ("grammar-field-swallowed", 17)]),
    ],
)
def test_lint(spark, text, want):
    assert codes(spark, text) == want


def test_severity_counts(spark):
    found = lint(spark.createDataFrame([("d", "")], "doc string, text string"))
    assert [tuple(r) for r in severity_counts(found).collect()] == [("d", 2, 0)]


def test_lines_are_neither_broadcast_nor_shuffled(spark, tmp_path):
    """Documents in a small file may have many lines: no join sends lines to the driver, and windows take documents as they are dealt."""
    spark.createDataFrame([("d", "$SELECT S\nPROMPT: p\nANSWER: a")], "doc string, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        for df in (lint(docs), figures.at_source(lint(docs), M.lines(docs))):
            assert "Broadcast" not in plan(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert plan(M.select_items(M.numbered(M.parse(docs), "SELECT"))).count("Exchange hashpartitioning") == 1


def test_activities_are_numbered_within_their_lesson(spark):
    text = "$SELECT A\n$CHAT B\n$LESSON One\n$SELECT C\nPROMPT: p\n$LESSON Two\n$LESSON Three\n$CHAT D\n$CHAT E"
    rows = M.activities(M.parse(spark.createDataFrame([("d", text)], "doc string, text string"))).select("lesson_no", "act_no", "title").collect()
    assert sorted(map(tuple, rows)) == [(1, 1, "A"), (1, 2, "B"), (2, 1, "C"), (4, 1, "D"), (4, 2, "E")]


def test_subwords_are_shuffled_as_texts(spark, tmp_path):
    """The shuffle stands below the cutting of texts into words and pieces, and none above it."""
    spark.createDataFrame([(1, "some words")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    lines = speech.subword_words(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().split("\n")
    assert max(k for k, x in enumerate(lines) if "Generate" in x) < min(k for k, x in enumerate(lines) if "Exchange" in x)


def test_nesting_reads_lines_once(spark):
    """Dialogues, exercises, plain lessons and empty activities in one value, from one pass over the lines."""
    text = "$DIALOGUE\nLINE:\nBob: {a.mp3}\nAnn: hi {p.png}\nLINE: more\nNOTES: n\n$LESSON Two\n$LESSON\n$SELECT S\nOPTION: a | One\nPROMPT: p {x.mp3}\nANSWER: ,\nTEMPLATE: t\nANSWER: b, a\nTEMPLATE: u\n$PRODUCE\nPROMPT:\nRESPONSE: r {r.mp3} {q.png}\n$CHAT C\n"
    out = M.nested(parsed(spark, text))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode") == 1
    lessons = out.collect()[0].lessons
    assert [(x.lesson_no, x.id, x.title) for x in lessons] == [(1, "default-lesson", "Default Lesson"), (2, "two", "Two"), (3, "untitled", "Untitled Lesson")]
    assert lessons[1].activities is None
    acts = [(a.act_no, a.type, a.id, a.title, a.items and [tuple(i) for i in a.items]) for x in lessons for a in x.activities or []]
    assert acts == [
        (1, "DIALOGUE", "dialogue-dialogue", "Dialogue", [(1, "hi", "Ann"), (2, "more", "Ann")]),
        (1, "SELECT", "select-s", "S", [(1, "p", "b,a"), (2, None, "")]),
        (2, "PRODUCE", "produce-produce", "Produce", [(1, "", "r {r.mp3} {q.png}")]), (3, "CHAT", "chat-c", "C", None),
    ]
