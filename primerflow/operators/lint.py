"""The linter: diagnostics of module text, each rule an expression over classified lines.

Two passes of windows give every line what the rules need: section context as the linter sees it (a $MODULE marker
closes the activity here, unlike in the parser), whether a blank line stands before, and item boundaries. Rules are
then one array of optional diagnostics per line, exploded once; rules about a whole document follow from one
aggregate. ``seq`` orders a document's diagnostics: errors first, then by line, then as rules are listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .module import ACTIVITIES, by_document, lines

# What the format allows where, and the names of voices.
MARKERS = ["CHAT", "DIALOGUE", "GRAMMAR", "LESSON", "MODULE", "PRODUCE", "SELECT"]
HEADER = ["DESCRIPTION", "DIOCO_DOC_ID", "FORMAT", "HOME_LANG_G", "TARGET_LANG_G", "TTS_PROMPT", "USER_LANG_G"]
VOICE = ["VOICE", "VOICE_DEFAULT", "VOICE_INTRO", "VOICE_PROMPT", "VOICE_RESPONSE", "VOICE_SPEAKER"]
ALLOWED = {
    "DIALOGUE": ["INSTRUCTION", "INTRO", "LINE", "NOTES", "TTS_PROMPT", "VOCAB"],
    "SELECT": ["ANSWER", "FEEDBACK", "INSTRUCTION", "INTRO", "OPTION", "PROMPT", "TEMPLATE"],
    "PRODUCE": ["ACCEPT", "CHECK", "INPUT", "INSTRUCTION", "INTRO", "PROMPT", "RESPONSE", "RUBRIC", "TEMPLATE", "TTS_PROMPT"],
    "GRAMMAR": ["INTRO"],
    "CHAT": ["INITIAL_PROMPT", "INTRO", "SCENARIO"],
}
ASSET_FIELDS = ["LINE", "PROMPT", "RESPONSE", "OPTION", "TEMPLATE"]
VOICE_NAMES = [
    "Zephyr", "Puck", "Charon", "Kore", "Fenrir", "Leda", "Orus", "Aoede", "Callirrhoe", "Autonoe",
    "Enceladus", "Iapetus", "Umbriel", "Algieba", "Despina", "Erinome", "Algenib", "Rasalgethi", "Laomedeia", "Achernar",
    "Alnilam", "Schedar", "Gacrux", "Pulcherrima", "Achird", "Zubenelgenubi", "Vindemiatrix", "Sadachbia", "Sadaltager", "Sulafat",
]

c = F.col


def _classes(docs: DataFrame) -> DataFrame:
    """kind of each line in the linter's order, with its parts."""
    marker = r"^\$(\w+)(?:" + T.SPACE + r"+(.*))?$"
    out = lines(by_document(docs)).withColumn("end", T.trim_end(c("raw"))).withColumn("bare", T.trim(c("raw")))
    kind = (
        F.when(c("bare") == "", "blank").when(c("bare").startswith("#"), "comment").when(c("end").startswith("$"), "marker")
        .when(c("bare").isin("MULTI", "REPEAT", "SHOW_PROMPT"), "flag").when(c("bare") == "AUDIO_ONLY", "audio_only").when(c("bare") == "EXAMPLE", "example")
        .when(c("end").rlike(T.FIELD), "field").otherwise("raw")
    )
    out = out.withColumn("kind", kind)
    is_marker, is_field = c("kind") == "marker", c("kind") == "field"
    raw_title = T.trim(F.regexp_extract("end", marker, 2))
    token = rf"(?s)^(.*?){T.SPACE}*\{{{T.SPACE}*([^{{}}]+?){T.SPACE}*\}}$"
    file = T.trim(F.split(F.regexp_extract(raw_title, token, 2), "@", -1)[0])
    has_image = raw_title.rlike(token) & file.rlike(T.IMAGE)
    return (
        out.withColumn("well_formed", is_marker & c("end").rlike(marker))
        .withColumn("marker", F.when(c("well_formed"), F.regexp_extract("end", marker, 1)))
        .withColumn("raw_title", F.when(c("well_formed"), raw_title))
        .withColumn("title_image", F.when(c("well_formed") & has_image, file))
        .withColumn("title", F.when(c("well_formed"), F.when(has_image, T.trim(F.regexp_extract(raw_title, token, 1))).otherwise(raw_title)))
        .withColumn("field", F.when(is_field, F.regexp_extract("end", T.FIELD, 1)))
        .withColumn("value", F.when(is_field, T.trim(F.regexp_extract("end", T.FIELD, 2))))
    )


def _context(rows: DataFrame) -> DataFrame:
    """Where each line stands: activity, lesson seen, header, blank line before, speaker and item facts."""
    w = Window.partitionBy("doc").orderBy("ln")
    upto, before = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.unboundedPreceding, -1)
    starts = c("marker").isin(ACTIVITIES)
    act = F.when(starts, c("marker")).when(c("marker").isin("MODULE", "LESSON"), F.lit(""))
    out = rows.withColumn("act", T.or_null(F.last(act, ignorenulls=True).over(upto)))
    out = out.withColumn("act_ln", F.nullif(F.last(F.when(starts, c("ln")).when(c("marker").isin("MODULE", "LESSON"), F.lit(-1)), ignorenulls=True).over(upto), F.lit(-1)))
    out = out.withColumn("lesson_ln", F.last(F.when(c("marker") == "LESSON", c("ln")), ignorenulls=True).over(upto))
    in_header = F.when(c("marker") == "MODULE", True).when(starts | (c("marker") == "LESSON"), False)
    out = out.withColumn("in_header", F.coalesce(F.last(in_header, ignorenulls=True).over(upto), F.lit(True)) & c("lesson_ln").isNull() & c("act").isNull())
    out = out.withColumn("module_seen", F.coalesce(F.max(c("marker") == "MODULE").over(upto), F.lit(False)))
    # comments and EXAMPLE are transparent for the blank line before
    gap = F.when(c("kind").isin("blank", "marker"), True).when(~c("kind").isin("comment", "example"), False)
    out = out.withColumn("blank_before", F.coalesce(F.last(gap, ignorenulls=True).over(before), F.lit(True)))
    lesson = F.coalesce("lesson_ln", F.lit(0))
    ident = T.slug(F.concat_ws("-", c("marker"), F.when(c("title") != "", c("title")).otherwise(F.lower("marker"))))
    out = out.withColumn("act_id", F.when(starts, ident)).withColumn("lesson_key", lesson)
    same_id = Window.partitionBy("doc", "lesson_key", "act_id")
    out = out.withColumn("first_id", F.when(starts, F.min("ln").over(same_id)))
    return _items(_voices(_speakers(out)))


def _speakers(out: DataFrame) -> DataFrame:
    """Speaker lines in dialogues; what the header declares up to each line; the first use of each undeclared speaker."""
    parts = F.transform(F.split("value", r"\|", -1), T.trim)
    legacy = rf"(?s)^(.+?){T.SPACE}*={T.SPACE}*([^|]+)(?:{T.SPACE}*\|{T.SPACE}*(.*))?$"
    head = c("in_header") & (c("kind") == "field")
    out = out.withColumn("legacy_ok", F.when(head & (c("field") == "VOICE_SPEAKER"), c("value").rlike(legacy)))
    out = out.withColumn("declares", F.when(head & (c("field") == "VOICE") & (F.size(parts) >= 2), parts[0]).when(c("legacy_ok"), T.trim(F.regexp_extract("value", legacy, 1))))
    voice = F.when(head & (c("field") == "VOICE") & (F.size(parts) >= 2), parts[1]).when(c("legacy_ok"), T.trim(F.regexp_extract("value", legacy, 2)))
    out = out.withColumn("voice", voice.when(head & c("field").isin([v for v in VOICE if v not in ("VOICE", "VOICE_SPEAKER")]), T.voice_of(c("value"))["voice"]))
    out = out.withColumn("speaker", F.when((c("kind") == "raw") & (c("act") == "DIALOGUE"), T.speaker_of(c("end"))))
    out = out.withColumn("key", F.lower(F.coalesce("speaker", "declares")))
    upto = Window.partitionBy("doc").orderBy("ln").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = Window.partitionBy("doc", "key").orderBy("ln").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumn("any_declared", F.coalesce(F.max(c("declares").isNotNull()).over(upto), F.lit(False)))
    out = out.withColumn("declared", F.coalesce(F.max(c("declares").isNotNull()).over(own), F.lit(False)))
    loose = c("speaker").isNotNull() & c("any_declared") & ~c("declared") & (c("key") != "narrator")
    out = out.withColumn("loose", F.coalesce(loose, F.lit(False)))
    return out.withColumn("undeclared", c("loose") & (F.sum(F.when(c("loose"), 1).otherwise(0)).over(own) == 1))


def _voices(out: DataFrame) -> DataFrame:
    """Earlier header fields and earlier VOICE_SPEAKER mappings of the same name."""
    head = c("in_header") & (c("kind") == "field") & c("field").isin([f for f in HEADER + VOICE if f not in ("VOICE", "VOICE_SPEAKER")])
    earlier = Window.partitionBy("doc", "field").orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("dup_field", head & (F.coalesce(F.sum(F.when(head, 1)).over(earlier), F.lit(0)) > 0))
    legacy = F.when(c("legacy_ok"), c("declares"))
    named = Window.partitionBy("doc", F.lower(legacy)).orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("legacy_first", F.when(c("legacy_ok"), F.first(legacy, ignorenulls=True).over(named)))


#: As in the parser, but every ANSWER closes an item here, an empty one too.
_SELECT = "P(?:[^PTA]*+T)?[^PT]*+|T(?:[^PTA]*+P)?[^PT]*+"
_PRODUCE = "P(?:[^PTR]*+T)?[^PT]*+|T(?:[^PTR]*+P)?[^PT]*+"


def _items(out: DataFrame) -> DataFrame:
    """item: number of the item that a field is in, 0 before any; opens: whether it starts one; answered: whether it has an answer."""
    rows = out.where((c("kind") == "field") & c("act").isin("SELECT", "PRODUCE"))
    code = F.when(c("field") == "PROMPT", "P").when(c("field") == "TEMPLATE", "T").when((c("act") == "SELECT") & (c("field") == "ANSWER"), "A").when((c("act") == "PRODUCE") & (c("field") == "RESPONSE"), "R").otherwise("x")
    grouped = rows.groupBy("doc", "act_ln", "act").agg(F.sort_array(F.collect_list(F.struct("ln", code.alias("code")))).alias("rows"))
    codes = F.array_join(c("rows.code"), "")
    pattern = lambda p: F.regexp_extract_all(codes, F.lit(p), 0)
    parts = F.concat(F.array(F.regexp_extract(codes, "^[^PT]*", 0)), F.when(c("act") == "SELECT", pattern(_SELECT)).otherwise(pattern(_PRODUCE)))
    number = F.flatten(F.transform(parts, lambda s, k: F.transform(F.sequence(F.lit(0), F.greatest(F.length(s) - 1, F.lit(0))), lambda j: F.struct(k.alias("item"), (j == 0).alias("opens"), s.contains("A").alias("answered"), (F.length(s) > 0).alias("real")))))
    listed = F.filter(number, lambda x: x["real"])
    items = grouped.select("doc", F.explode(F.arrays_zip("rows", listed.alias("n"))).alias("r")).select("doc", c("r.rows.ln").alias("ln"), "r.n.item", (c("r.n.opens") & (c("r.n.item") > 0)).alias("opens"), "r.n.answered")
    return out.join(items.hint("merge"), ["doc", "ln"], "left")  # sizes are guessed from the documents': lines would be broadcast


def lint(docs: DataFrame) -> DataFrame:
    """doc, severity, line, code, seq of all diagnostics."""
    rows = _context(_classes(docs))
    field, value, act, kind = c("field"), c("value"), c("act"), c("kind")
    is_field, is_marker, in_act = kind == "field", kind == "marker", act.isNotNull()
    indented = c("raw").rlike("^[ \t]") & ~kind.isin("blank", "comment")
    starts = c("marker").isin(ACTIVITIES)
    facts = T.asset_facts(F.when(c("speaker").isNotNull(), F.regexp_extract("end", T.SPEAKER, 2)).otherwise(value))
    carries = (is_field & in_act & field.isin(ASSET_FIELDS)) | c("speaker").isNotNull()
    a = lambda n: F.when(carries, c("facts")[n])
    head = is_field & c("in_header")
    legacy = is_field & in_act & ~c("in_header") & field.isin("SPEAKER", "OPTION_IMAGE", "PROMPT_IMAGE", "IMAGE")
    body = is_field & in_act & ~legacy
    loose = is_field & ~in_act & ~c("in_header")
    allowed = F.create_map(*[x for k, v in ALLOWED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    select, produce = body & (act == "SELECT"), body & (act == "PRODUCE")
    stimulus = field.isin("PROMPT", "TEMPLATE")
    parts = F.split(value, r"\|", -1)
    known = head & field.isin(HEADER + VOICE)
    name_bad = c("voice").isNotNull() & ~c("voice").rlike(T.IDENTIFIER)
    rules: list[tuple[str, str, Column]] = [
        ("error", "section-indent", indented & T.trim_start(c("raw")).startswith("$")),
        ("error", "field-indent", indented & T.trim_start(c("raw")).rlike("^[A-Z_]+:")),
        ("error", "section-colon", is_marker & c("end").rlike(rf"^\$(LESSON|DIALOGUE|GRAMMAR|SELECT|PRODUCE|CHAT){T.SPACE}*:")),
        ("warning", "section-format", is_marker & ~c("well_formed")),
        ("warning", "title-asset-invalid", c("raw_title").endswith("}") & c("title_image").isNull()),
        ("warning", "title-image-unsupported", c("title_image").isNotNull() & c("marker").isin("LESSON", "GRAMMAR", "CHAT")),
        ("warning", "section-unknown", c("marker").isNotNull() & ~c("marker").isin(MARKERS)),
        ("warning", "implicit-lesson", starts & c("lesson_ln").isNull()),
        ("warning", "dup-activity-id", starts & (c("first_id") < c("ln"))),
        ("warning", "repeat-outside-dialogue", (c("bare") == "REPEAT") & (kind == "flag") & ~F.coalesce(act.isin("DIALOGUE", "SELECT", "PRODUCE"), F.lit(False))),
        ("warning", "flag-outside-select", (c("bare") == "MULTI") & (kind == "flag") & ~F.coalesce(act == "SELECT", F.lit(False))),
        ("warning", "flag-outside-show-prompt", (c("bare") == "SHOW_PROMPT") & (kind == "flag") & ~F.coalesce(act.isin("SELECT", "PRODUCE"), F.lit(False))),
        ("error", "legacy-audio-only", kind == "audio_only"),
        ("warning", "example-outside-item", (kind == "example") & ~F.coalesce(act.isin("SELECT", "PRODUCE"), F.lit(False))),
        ("warning", "asset-not-trailing", a("total") > a("trailing")),
        ("warning", "template-with-clip", (field == "TEMPLATE") & (a("audio") > 0)),
        ("warning", "multiple-inline-clips", (F.coalesce(field, F.lit("")) != "TEMPLATE") & (a("audio") > 1)),
        ("warning", "multiple-inline-images", a("image") > 1),
        ("warning", "response-with-image", (field == "RESPONSE") & (a("image") > 0)),
        ("error", "legacy-title-field", head & (field == "TITLE")),
        ("error", "legacy-image-field-header", head & (field == "IMAGE")),
        ("warning", "unknown-header-field", head & ~known & ~field.isin("TITLE", "IMAGE")),
        ("warning", "dup-header-field", c("dup_field")),
        ("error", "format-invalid", head & (field == "FORMAT") & (value != "2")),
        ("warning", "voice_speaker-deprecated", head & (field == "VOICE_SPEAKER")),
        ("error", "voice_speaker-format", head & (field == "VOICE_SPEAKER") & ~c("legacy_ok")),
        ("warning", "voice_speaker-label", c("legacy_ok") & ~c("declares").rlike(T.IDENTIFIER)),
        ("error", "voice-format", head & (field == "VOICE") & (F.size(parts) < 2)),
        ("warning", "voice-speaker-id", head & (field == "VOICE") & ~c("declares").rlike(T.IDENTIFIER)),
        ("warning", "voice_name", head & name_bad),
        ("error", "voice-invalid", head & c("voice").isNotNull() & ~F.lower("voice").isin([v.lower() for v in VOICE_NAMES])),
        ("warning", "voice_speaker-dup", c("legacy_first").isNotNull()),
        ("warning", "voice_speaker-case", c("legacy_first") != c("declares")),
        ("error", "legacy-speaker-field", legacy & (field == "SPEAKER")),
        ("error", "legacy-image-field", legacy & (field != "SPEAKER")),
        ("warning", "field-unexpected", body & ~F.array_contains(F.element_at(allowed, act), field)),
        ("warning", "grammar-field-swallowed", body & (act == "GRAMMAR") & (field != "INTRO")),
        ("warning", "empty-prompt", select & stimulus & (value == "")),
        ("warning", "select-missing-answer", select & c("opens") & ~c("answered")),
        ("warning", "item-needs-blank-line", (select | produce) & c("opens") & (c("item") > 1) & ~c("blank_before")),
        ("warning", "answer-before-prompt", select & (field == "ANSWER") & (c("item") == 0)),
        ("warning", "empty-answer", select & (field == "ANSWER") & (value == "")),
        ("warning", "option-format", select & (field == "OPTION") & ~value.rlike(r"^[^|]+\|")),
        ("warning", "input-invalid", produce & (field == "INPUT") & (value != "") & ~F.lower("value").isin("type", "speak")),
        ("warning", "check-invalid", produce & (field == "CHECK") & (value != "") & ~F.lower("value").isin("reveal", "exact", "llm")),
        ("warning", "response-before-stimulus", produce & (field == "RESPONSE") & (c("item") == 0)),
        ("warning", "empty-response", produce & (field == "RESPONSE") & (value == "")),
        ("warning", "header-before-module", loose & ~c("module_seen") & field.isin(HEADER + VOICE)),
        ("warning", "field-outside-activity", loose & ~(~c("module_seen") & field.isin(HEADER + VOICE))),
        ("warning", "speaker-empty-line", c("speaker").isNotNull() & (T.trim(F.regexp_extract("end", T.SPEAKER, 2)) == "")),
        ("warning", "speaker-undeclared", c("undeclared")),
        ("warning", "raw-content", (kind == "raw") & c("speaker").isNull() & act.isin("DIALOGUE", "SELECT", "PRODUCE", "CHAT")),
        ("warning", "content-outside", (kind == "raw") & ~in_act),
    ]
    found = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(s).alias("severity"), F.lit(k).alias("code"), F.lit(n).alias("rule"))) for n, (s, k, when) in enumerate(rules)]))
    by_row = rows.withColumn("facts", facts).select("doc", c("ln").alias("line"), F.explode(found).alias("d")).select("doc", "d.severity", "line", "d.code", "d.rule")
    out = by_row.unionByName(_whole(rows))
    order = Window.partitionBy("doc").orderBy("severity", "line", "rule")
    return out.withColumn("seq", F.row_number().over(order)).drop("rule")


def _whole(rows: DataFrame) -> DataFrame:
    """Rules about a whole document, and the EXAMPLE that no item follows."""
    used = (c("kind") == "field") & c("act").isin("SELECT", "PRODUCE") & c("field").isin("PROMPT", "TEMPLATE")
    example = (c("kind") == "example") & c("act").isin("SELECT", "PRODUCE")
    has = lambda f: F.coalesce(F.bool_or(c("in_header") & (c("field") == f)), F.lit(False)).alias(f)
    facts = rows.groupBy("doc").agg(
        F.coalesce(F.bool_or(c("kind") == "marker"), F.lit(False)).alias("sections"), F.coalesce(F.bool_or(c("marker") == "MODULE"), F.lit(False)).alias("module"), F.coalesce(F.bool_or((c("marker") == "MODULE") & (c("title") != "")), F.lit(False)).alias("title"),
        *map(has, ("FORMAT", "DIOCO_DOC_ID", "TARGET_LANG_G", "HOME_LANG_G", "USER_LANG_G")), F.max(F.when(example, c("ln"))).alias("example"), F.max(F.when(used | c("marker").isin(ACTIVITIES), c("ln"))).alias("used"),
    )
    module = c("module")
    rules = [
        ("warning", "example-not-applied", c("example") > F.coalesce("used", F.lit(0)), c("example")), ("error", "no-sections", ~c("sections"), F.lit(1)), ("error", "missing-module", ~module, F.lit(1)),
        ("warning", "missing-format", module & ~c("FORMAT"), F.lit(1)), ("warning", "missing-dioco-doc-id", module & ~c("DIOCO_DOC_ID"), F.lit(1)), ("error", "missing-title", module & ~c("title"), F.lit(1)),
        ("error", "missing-target-lang", module & ~c("TARGET_LANG_G"), F.lit(1)), ("error", "missing-home-lang", module & ~c("HOME_LANG_G") & ~c("USER_LANG_G"), F.lit(1)),
    ]
    found = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(s).alias("severity"), line.cast("int").alias("line"), F.lit(k).alias("code"), F.lit(100 + n).alias("rule"))) for n, (s, k, when, line) in enumerate(rules)]))
    return facts.select("doc", F.explode(found).alias("d")).select("doc", "d.*")


def severity_counts(diagnostics: DataFrame) -> DataFrame:
    """doc, errors, warnings."""
    return diagnostics.groupBy("doc").agg(F.count_if(c("severity") == "error").alias("errors"), F.count_if(c("severity") == "warning").alias("warnings"))
