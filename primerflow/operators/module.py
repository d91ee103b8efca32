"""Module text to typed tables: lines, their class and context, and the items that they make up.

Everything is keyed by (doc, ln) and windowed by document, so documents are the unit of parallelism; nothing leaves
the JVM. The two item state machines are regular: each activity's lines become a string of one letter a line, and a
pattern cuts that string into items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Markers, flags, and the fields that an activity takes for itself wherever they stand.
ACTIVITIES = ["DIALOGUE", "GRAMMAR", "SELECT", "PRODUCE", "CHAT"]
FLAGS = ["REPEAT", "SHOW_PROMPT", "MULTI", "EXAMPLE"]
ABSORBED = ["INTRO", "INSTRUCTION", "TTS_PROMPT", "INPUT", "CHECK", "SCENARIO", "INITIAL_PROMPT"]
_TITLES = {"DIALOGUE": "Dialogue", "GRAMMAR": "Grammar", "SELECT": "Select", "PRODUCE": "Produce", "CHAT": "Chat"}
KEY = ["doc", "lesson_no", "act_no"]


def _so_far() -> Window:
    return Window.partitionBy("doc").orderBy("ln").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def lines(docs: DataFrame) -> DataFrame:
    """doc, ln (from 1), raw of each line; empty last lines and carriage returns stay."""
    return docs.select("doc", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("p", "raw")).select("doc", (F.col("p") + 1).alias("ln"), "raw")


def by_document(docs: DataFrame) -> DataFrame:
    """docs dealt out by document before they are cut into lines: windows, groups and joins over a document's lines need no
    further shuffle, and all that is made of them reads this one. Short texts make many lines, so the number of parts is held."""
    return docs.select("doc", "text").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc")


def classify(rows: DataFrame) -> DataFrame:
    """kind of each line, and its parts (P02, P03, P06, P07): comment, blank, marker, flag, field or raw, in that order."""
    end = T.trim_end(F.col("raw"))
    marker = r"^\$(\w+)(?:" + T.SPACE + r"+(.*))?$"
    out = rows.withColumn("end", end).withColumn("bare", T.trim_start(F.col("end")))
    kind = (
        F.when(F.col("bare").startswith("#"), "comment")
        .when(F.col("bare") == "", "blank")
        .when(F.col("end").startswith("$"), "marker")
        .when(F.col("bare").isin(FLAGS), "flag")
        .when(F.col("end").rlike(T.FIELD), "field")
        .otherwise("raw")
    )
    out = out.withColumn("kind", kind)
    is_marker, is_field = F.col("kind") == "marker", F.col("kind") == "field"
    title = T.peel(F.regexp_extract("end", marker, 2), audio=False)
    return (
        out.withColumn("marker", F.when(is_marker, T.or_null(F.regexp_extract("end", marker, 1))))
        .withColumn("peeled", F.when(is_marker, title))
        .withColumn("field", F.when(is_field, F.regexp_extract("end", T.FIELD, 1)))
        .withColumn("value", F.when(is_field, F.regexp_extract("end", T.FIELD, 2)))
        .select("*", F.col("peeled.text").alias("title"), F.col("peeled.image").alias("title_image"))
        .drop("peeled")
    )


def context(classified: DataFrame) -> DataFrame:
    """The lesson and activity that each line is in (W01). A lesson ends the activity; one is made up for an activity
    before any lesson. lesson_no 0 is the header."""
    starts, opens, so_far = F.col("marker").isin(ACTIVITIES), F.col("marker") == "LESSON", _so_far()
    out = classified.withColumn("opened", F.sum(F.when(opens, 1).otherwise(0)).over(so_far))
    out = out.withColumn("made_up", F.coalesce(F.max(F.when(starts & (F.col("opened") == 0), 1)).over(so_far), F.lit(0)))
    out = out.withColumn("lesson_no", (F.col("opened") + F.col("made_up")).cast("int"))
    at = F.last(F.when(starts, F.col("ln")).when(opens, F.lit(-1)), ignorenulls=True).over(so_far)
    act = F.last(F.when(starts, F.col("marker")).when(opens, F.lit("")), ignorenulls=True).over(so_far)
    out = out.withColumn("act_ln", F.nullif(at, F.lit(-1))).withColumn("act_type", T.or_null(act))
    # activities so far but those of earlier lessons: the same window again, no second sort
    out = out.withColumn("started", F.sum(F.when(starts, 1).otherwise(0)).over(so_far))
    earlier = F.coalesce(F.last(F.when(opens, F.col("started")), ignorenulls=True).over(so_far), F.lit(0))
    return out.withColumn("act_no", F.when(F.col("act_ln").isNotNull(), (F.col("started") - earlier).cast("int"))).drop("opened", "made_up", "started")


def parse(docs: DataFrame) -> DataFrame:
    """Classified lines with context."""
    return context(classify(lines(by_document(docs))))


def buffered(ctx: DataFrame) -> DataFrame:
    """Lines that an activity keeps (P08, P09): fields it does not absorb, EXAMPLE, and raw lines."""
    keeps = F.when(F.col("kind") == "field", ~F.col("field").isin(ABSORBED)).when(F.col("kind") == "flag", F.col("bare") == "EXAMPLE").otherwise(F.col("kind") == "raw")
    return ctx.where(F.col("act_ln").isNotNull() & keeps)


def lessons(ctx: DataFrame) -> DataFrame:
    """doc, lesson_no, id, title."""
    title = F.max(F.when(F.col("marker") == "LESSON", T.or_null(F.col("title")))).alias("t")
    opened = F.max(F.when(F.col("marker") == "LESSON", 1)).alias("o")
    out = ctx.where("lesson_no > 0").groupBy("doc", "lesson_no").agg(title, opened)
    return out.select("doc", "lesson_no", *_lesson(F.col("o").isNull()))


def _lesson(made: Column) -> tuple[Column, Column]:
    """id and title of a lesson with title ``t``, or of one that is made up."""
    return F.when(made, "default-lesson").otherwise(T.slug(F.coalesce("t", F.lit("Untitled")))).alias("id"), F.when(made, "Default Lesson").otherwise(F.coalesce("t", F.lit("Untitled Lesson"))).alias("title")


def activities(ctx: DataFrame) -> DataFrame:
    """A row per activity with defaults, flags and absorbed fields; the last of a repeated field wins."""
    rows = ctx.where(F.col("act_ln").isNotNull())
    kind = F.col("act_type")

    def last(field: str, *kinds: str) -> Column:
        use = (F.col("field") == field) & (kind.isin(*kinds) if kinds else F.lit(True))
        return F.max_by(F.when(use, F.col("value")), F.when(use, F.col("ln")))

    def flag(name: str, *kinds: str) -> Column:
        return F.coalesce(F.bool_or((F.col("kind") == "flag") & (F.col("bare") == name) & kind.isin(*kinds)), F.lit(False))

    titles = F.create_map(*[F.lit(x) for kv in _TITLES.items() for x in kv])
    first = F.col("ln") == F.col("act_ln")
    out = rows.groupBy(*KEY, F.col("act_type").alias("type")).agg(
        F.max(F.when(first, T.or_null(F.col("title")))).alias("own"),
        F.max(F.when(first & kind.isin("DIALOGUE", "SELECT", "PRODUCE"), F.col("title_image"))).alias("image"),
        last("INTRO").alias("intro"),
        last("INSTRUCTION", "DIALOGUE", "SELECT", "PRODUCE").alias("instruction"),
        last("TTS_PROMPT", "DIALOGUE", "PRODUCE").alias("tts_prompt"),
        last("INPUT", "PRODUCE").alias("input"),
        last("CHECK", "PRODUCE").alias("check"),
        last("SCENARIO", "CHAT").alias("scenario"),
        last("INITIAL_PROMPT", "CHAT").alias("initial_prompt"),
        flag("REPEAT", "DIALOGUE", "SELECT", "PRODUCE").alias("repeat"),
        flag("SHOW_PROMPT", "SELECT", "PRODUCE").alias("show_prompt"),
        flag("MULTI", "SELECT").alias("multi"),
        F.min("act_ln").alias("ln"),
    )
    produce = F.col("type") == "PRODUCE"
    out = out.withColumn("title", F.coalesce("own", F.element_at(titles, F.col("type")))).drop("own")
    return (
        out.withColumn("id", T.slug(F.concat_ws("-", "type", "title")))
        .withColumn("input", F.when(produce, T.input_mode(F.coalesce("input", F.lit("")))))
        .withColumn("check", F.when(produce, T.check_mode(F.coalesce("check", F.lit("")))))
        .withColumn("scenario", F.when(F.col("type") == "CHAT", F.coalesce("scenario", F.lit(""))))
        .withColumn("initial_prompt", F.when(F.col("type") == "CHAT", F.coalesce("initial_prompt", F.lit(""))))
    )


def grammar(ctx: DataFrame) -> DataFrame:
    """The text of GRAMMAR activities: raw lines, other fields as ``FIELD:value``, and blank lines, in order."""
    rows = ctx.where(F.col("act_type") == "GRAMMAR")
    keeps = (F.col("kind").isin("raw", "blank")) | ((F.col("kind") == "field") & ~F.col("field").isin(ABSORBED)) | ((F.col("kind") == "flag") & (F.col("bare") == "EXAMPLE"))
    line = F.when(F.col("kind") == "blank", "").when(F.col("kind") == "field", F.concat_ws(":", "field", "value")).when(F.col("kind") == "flag", F.lit("EXAMPLE")).otherwise(F.col("raw"))
    out = rows.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.when(keeps, F.struct("ln", line.alias("l"))))).alias("p"))
    return out.select(*KEY, T.trim(F.array_join(F.col("p.l"), "\n")).alias("content"))


def header(ctx: DataFrame) -> DataFrame:
    """One row per document: title and cover of the module, header fields (last wins), and what is missing."""
    top = (F.col("lesson_no") == 0) & F.col("act_ln").isNull() & (F.col("kind") == "field")

    def last(*fields: str) -> Column:
        use = top & F.col("field").isin(*fields)
        return F.max_by(F.when(use, F.col("value")), F.when(use, F.col("ln")))

    def marked(name: str) -> Column:
        use = (F.col("marker") == "MODULE") & (F.col(name) != "")
        return F.max_by(F.when(use, F.col(name)), F.when(use, F.col("ln")))

    out = ctx.groupBy("doc").agg(
        marked("title").alias("title"), marked("title_image").alias("image"), last("DIOCO_DOC_ID").alias("module_key"), last("DESCRIPTION").alias("description"),
        last("TARGET_LANG_G").alias("target_lang"), last("HOME_LANG_G", "USER_LANG_G").alias("home_lang"), last("TTS_PROMPT").alias("tts_prompt"),
    )
    missing = F.filter(F.array(*[F.when(F.col(c).isNull() | (F.col(c) == ""), F.lit(c)) for c in ("title", "target_lang", "home_lang")]), lambda x: x.isNotNull())
    return out.withColumn("module_key", F.coalesce("module_key", F.lit(""))).withColumn("missing", missing)


def voices(ctx: DataFrame) -> DataFrame:
    """doc, slot, speaker, voice, prompt: default voices by slot, and speakers' voices, the last of each winning (P10)."""
    top = ctx.where((F.col("lesson_no") == 0) & F.col("act_ln").isNull() & (F.col("kind") == "field") & F.col("field").startswith("VOICE"))
    legacy = rf"(?s)^(.+?){T.SPACE}*={T.SPACE}*([^|]+)(?:{T.SPACE}*\|{T.SPACE}*(.*))?$"
    parts = F.transform(F.split("value", r"\|", -1), T.trim)
    value = F.col("value")
    spec = (
        F.when(F.col("field") == "VOICE", F.when(F.size(parts) >= 2, F.struct(parts[0].alias("speaker"), parts[1].alias("voice"), T.or_null(F.array_join(F.slice(parts, 3, 1000), " | ")).alias("prompt"))))
        .when(F.col("field") == "VOICE_SPEAKER", F.when(value.rlike(legacy), F.struct(T.trim(F.regexp_extract("value", legacy, 1)).alias("speaker"), T.trim(F.regexp_extract("value", legacy, 2)).alias("voice"), T.or_null(T.trim(F.regexp_extract("value", legacy, 3))).alias("prompt"))))
        .when(F.col("field").isin("VOICE_DEFAULT", "VOICE_PROMPT", "VOICE_RESPONSE", "VOICE_INTRO"), F.struct(F.lit(None).cast("string").alias("speaker"), T.voice_of(value)["voice"].alias("voice"), T.voice_of(value)["prompt"].alias("prompt")))
    )
    slot = F.when(F.col("field").isin("VOICE", "VOICE_SPEAKER"), "speaker").otherwise(F.lower(F.substring("field", 7, 20)))
    rows = top.withColumn("spec", spec).where("spec IS NOT NULL").select("doc", "ln", slot.alias("slot"), "spec.*")
    newest = F.max_by(F.struct("voice", "prompt"), "ln").alias("v")
    return rows.groupBy("doc", "slot", "speaker").agg(newest).select("doc", "slot", "speaker", "v.voice", "v.prompt")


def dialogue_lines(ctx: DataFrame) -> DataFrame:
    """Spoken lines of dialogues (W05): a line opens at LINE or a speaker; a LINE goes on with the speaker; lines without
    text are reopened by the next, which then keeps what they had gathered. Notes go to the open line."""
    rows = buffered(ctx.where(F.col("act_type") == "DIALOGUE"))
    item = F.when(F.col("kind") == "field", F.concat_ws(":", "field", "value")).otherwise(F.col("raw"))
    rows = rows.withColumn("item", item)
    is_field = F.col("kind") == "field"
    what = F.when(is_field & F.col("field").isin("VOCAB", "NOTES", "LINE"), F.col("field")).when(T.speaker_of(F.col("item")).isNotNull(), "SPEAKER")
    said = F.when(F.col("what") == "LINE", F.col("value")).when(F.col("what") == "SPEAKER", F.regexp_extract("item", T.SPEAKER, 2))
    rows = rows.withColumn("what", what).where("what IS NOT NULL").withColumn("p", T.peel(said)).withColumn("name", F.when(F.col("what") == "SPEAKER", T.speaker_of(F.col("item"))))
    act = Window.partitionBy(*KEY).orderBy("ln")
    before = act.rowsBetween(Window.unboundedPreceding, -1)
    upto = act.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = F.col("what").isin("LINE", "SPEAKER")
    full = opens & (F.col("p.text") != "")
    # a line is closed by the next opening after it has text: count closed lines before each row
    rows = rows.withColumn("opening", opens).withColumn("last_full", F.coalesce(F.last(F.when(opens, full), ignorenulls=True).over(before), F.lit(False)))
    rows = rows.withColumn("line_no", F.sum(F.when(opens & F.col("last_full"), 1).otherwise(0)).over(upto))
    rows = rows.withColumn("speaker", F.last("name", ignorenulls=True).over(upto))
    # vocabulary waits for the next opening line
    rows = rows.withColumn("vocab_line", F.when(F.col("what") == "VOCAB", F.first(F.when(opens, F.col("line_no")), ignorenulls=True).over(act.rowsBetween(1, Window.unboundedFollowing))))
    vocab = rows.where("vocab_line IS NOT NULL").groupBy(*KEY, F.col("vocab_line").alias("line_no")).agg(F.sort_array(F.collect_list(F.struct("ln", T.trim(F.col("value")).alias("w"))))["w"].alias("vocab"))
    opening = F.when(F.col("opening"), F.col("ln"))
    noted = F.when(F.col("what") == "NOTES", F.col("ln"))
    pictured = F.when(F.col("opening") & F.col("p.image").isNotNull(), F.col("ln"))
    out = rows.groupBy(*KEY, "line_no").agg(
        F.max_by("speaker", opening).alias("speaker"), F.max_by("p.text", opening).alias("text"), F.max_by("p.audio", opening).alias("audio"),
        F.max_by("p.image", pictured).alias("image"), T.or_null(F.max_by(T.trim(F.col("value")), noted)).alias("notes"),
    ).where("text <> ''")
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy("line_no")).alias("n")
    return out.join(vocab, [*KEY, "line_no"], "left").select(*KEY, number, "speaker", "text", "notes", "image", "audio", "vocab").withColumnRenamed("n", "line_no")


#: An item starts at a prompt or template (P, T) and takes in one of the other kind unless an answer has closed it.
#: A: an answer with ids, a: an empty one, which opens the item again. R: a response.
_SELECT = "P(?:(?:[^PTA]++|A[^PTa]*+a)*+T)?[^PT]*+|T(?:(?:[^PTA]++|A[^PTa]*+a)*+P)?[^PT]*+"
_PRODUCE = "P(?:[^PTR]*+T)?[^PT]*+|T(?:[^PTR]*+P)?[^PT]*+"


def numbered(ctx: DataFrame, kind: str) -> DataFrame:
    """Buffered lines of SELECT or PRODUCE activities with item_no (W03, W04; 0 before the first item) and is_example.

    The lines of an activity are one array, sorted; activities are pages of a book, so it is short."""
    rows = buffered(ctx.where(F.col("act_type") == kind))
    field, value = F.col("field"), F.col("value")
    code = F.when(F.col("kind") == "flag", "E").when(field == "PROMPT", "P").when(field == "TEMPLATE", "T")
    if kind == "SELECT":
        code = code.when(field == "ANSWER", F.when(F.size(T.listed(value, ",")) > 0, "A").otherwise("a"))
    else:
        code = code.when(field == "RESPONSE", "R")
    rows = rows.withColumn("code", code.otherwise("x"))
    grouped = rows.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("ln", "code", "field", "value"))).alias("rows"))
    codes = F.array_join(F.col("rows.code"), "")
    lead = F.regexp_extract(codes, "^[^PT]*", 0)
    grouped = grouped.withColumn("items", F.concat(F.array(lead), F.regexp_extract_all(codes, F.lit(_SELECT if kind == "SELECT" else _PRODUCE), 0)))
    number = F.flatten(F.transform("items", lambda s, k: F.array_repeat(k, F.length(s))))
    shown = F.transform("items", lambda s, k: F.when(k > 0, F.get(F.col("items"), k - 1).contains("E")).otherwise(F.lit(False)))
    out = grouped.select(*KEY, F.explode(F.arrays_zip("rows", number.alias("item_no"))).alias("r"), shown.alias("shown"))
    return out.select(*KEY, "r.rows.ln", "r.rows.code", "r.rows.field", "r.rows.value", "r.item_no", F.get("shown", F.col("r.item_no")).alias("is_example"))


def _last(use: Column, value) -> Column:
    return F.max_by(F.when(use, value), F.when(use, F.col("ln")))


def _peeled(rows: DataFrame) -> DataFrame:
    """Values without their tokens, as prompts, templates and responses may have them; made once."""
    part = lambda code, **allow: F.when(F.col("code") == code, T.peel(F.col("value"), **allow))
    return rows.withColumns({"peeled": part("P"), "shown": part("T", audio=False), "said": part("R", image=False)})


def select_options(rows: DataFrame) -> DataFrame:
    """Options by id (A03): the first keeps the place, later ones fill in what they bring. item_no 0 is the pool."""
    option = T.option_of(F.col("value"))
    own = rows.where(F.col("field") == "OPTION").withColumn("o", option).where("o IS NOT NULL").withColumn("p", T.peel(F.col("o.value")))
    late = lambda c: _last(c.isNotNull(), c)
    out = own.groupBy(*KEY, "item_no", F.col("o.id").alias("id")).agg(F.min("ln").alias("ln"), late(T.or_null(F.col("p.text"))).alias("text"), late(F.col("p.image")).alias("image"), late(F.col("p.audio")).alias("audio"))
    return out.withColumn("pos", F.row_number().over(Window.partitionBy(*KEY, "item_no").orderBy("ln"))).drop("ln")


def select_items(rows: DataFrame) -> DataFrame:
    """Items of SELECT activities, without their options."""
    rows = _peeled(rows)
    prompt, template = F.col("peeled"), F.col("shown")
    is_prompt, is_template = F.col("code") == "P", F.col("code") == "T"
    answers = F.col("code").isin("A", "a")
    feedback = F.col("field") == "FEEDBACK"
    return rows.where("item_no > 0").groupBy(*KEY, "item_no").agg(
        _last(is_prompt, prompt["text"]).alias("prompt"), _last(is_template, template["text"]).alias("template"),
        F.coalesce(_last(is_prompt, prompt["image"]), _last(is_template, template["image"])).alias("prompt_image"), _last(is_prompt, prompt["audio"]).alias("audio"),
        F.coalesce(_last(answers, T.listed(F.col("value"), ",")), F.array().cast("array<string>")).alias("answer"),
        T.or_null(_last(feedback, T.trim(F.col("value")))).alias("feedback"), F.first("is_example").alias("is_example"),
    )


def produce_items(rows: DataFrame) -> DataFrame:
    """Items of PRODUCE activities."""
    rows = _peeled(rows)
    prompt, template, response = F.col("peeled"), F.col("shown"), F.col("said")
    is_prompt, is_template, is_response = (F.col("code") == c for c in "PTR")
    accept = F.col("field") == "ACCEPT"
    with_audio = is_response & response["audio"].isNotNull()
    return rows.where("item_no > 0").groupBy(*KEY, "item_no").agg(
        _last(is_prompt, prompt["text"]).alias("prompt"), _last(is_template, template["text"]).alias("template"),
        F.coalesce(_last(is_prompt, prompt["image"]), _last(is_template, template["image"])).alias("prompt_image"), _last(is_prompt, prompt["audio"]).alias("audio"),
        _last(is_response, response["text"]).alias("response"), _last(with_audio, response["audio"]).alias("response_audio"),
        _last(accept, T.listed(F.col("value"), r"\|")).alias("accept"), T.or_null(_last(F.col("field") == "RUBRIC", T.trim(F.col("value")))).alias("rubric"), F.first("is_example").alias("is_example"),
    )


def item_options(items: DataFrame, options: DataFrame) -> DataFrame:
    """Each item's options in order: its own, or the pool of its activity (J05); and the first of them that it answers."""
    nested = options.groupBy(*KEY, "item_no").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "text", "image", "audio"))).alias("options"))
    pool = nested.where("item_no = 0").drop("item_no").withColumnRenamed("options", "pool")
    out = items.join(nested, [*KEY, "item_no"], "left").join(pool, KEY, "left")
    own = F.coalesce("options", "pool")
    return out.withColumn("options", own).drop("pool").withColumn("chosen", F.get(F.filter("options", lambda o: F.array_contains(F.col("answer"), o["id"])), F.lit(0)))


def list_item(ctx: DataFrame) -> DataFrame:
    """doc, lessons, activities: counts of a module."""
    count = F.count_if(F.col("marker").isin(ACTIVITIES)).alias("activities")
    return ctx.groupBy("doc").agg(F.max("lesson_no").cast("long").alias("lessons"), count)


def block_ranges(ctx: DataFrame) -> DataFrame:
    """doc, marker, title, start_line, end_line: a block goes to the line before the next marker or the last."""
    marks = ctx.where(F.col("marker").isin("LESSON", *ACTIVITIES))
    ends = ctx.groupBy("doc").agg(F.max("ln").alias("n"))
    nxt = F.lead("ln").over(Window.partitionBy("doc").orderBy("ln"))
    return marks.withColumn("next", nxt).join(ends, "doc").select("doc", "marker", "title", F.col("ln").alias("start_line"), F.coalesce(F.col("next") - 1, "n").alias("end_line"))


def outline(ctx: DataFrame) -> DataFrame:
    """A row per lesson with its activities in order."""
    acts = activities(ctx).groupBy("doc", "lesson_no").agg(F.sort_array(F.collect_list(F.struct("act_no", "type", "id", "title"))).alias("activities"))
    return lessons(ctx).join(acts, ["doc", "lesson_no"], "left")


def items_per_activity(ctx: DataFrame) -> DataFrame:
    """doc, lesson_no, act_no, type, n_items: lines of dialogues, items of exercises, null for the other types."""
    lines_ = dialogue_lines(ctx).groupBy(*KEY).agg(F.count("*").alias("n"))
    items = [numbered(ctx, kind).where("item_no > 0").groupBy(*KEY).agg(F.count_distinct("item_no").alias("n")) for kind in ("SELECT", "PRODUCE")]
    counted = lines_.unionByName(items[0]).unionByName(items[1])
    n = F.when(F.col("type").isin("DIALOGUE", "SELECT", "PRODUCE"), F.coalesce("n", F.lit(0)))
    return activities(ctx).join(counted, KEY, "left").select(*KEY, "type", n.alias("n_items"))


def with_prompt(items: DataFrame) -> DataFrame:
    """Items with a prompt or a template; an empty one counts (P17). Lines without text are left out by ``dialogue_lines``."""
    return items.where("prompt IS NOT NULL OR template IS NOT NULL")


def nested(ctx: DataFrame) -> DataFrame:
    """doc, lessons: the whole module as one value, lines and items in their activities in their lessons, all in order.

    Lines are read once: each activity's lines that tell are one sorted array, as in ``numbered``, and its items are cut
    from that array by the same patterns. Each item starts with a prompt or a template, so all of them count (P17)."""
    kind, field, value = F.col("act_type"), F.col("field"), F.col("value")
    says, exercise = kind == "DIALOGUE", kind.isin("SELECT", "PRODUCE")
    keeps = F.col("act_ln").isNotNull() & F.col("kind").isin("field", "raw")
    name = F.when(keeps & says & (F.col("kind") == "raw"), T.speaker_of(F.col("raw")))
    rows = ctx.where("lesson_no > 0").withColumn("name", name)
    code = (
        F.when(F.col("name").isNotNull(), "S").when(says & (field == "LINE"), "L")
        .when(exercise & (field == "PROMPT"), "P").when(exercise & (field == "TEMPLATE"), "T")
        .when((kind == "SELECT") & (field == "ANSWER"), "A").when((kind == "PRODUCE") & (field == "RESPONSE"), "R")
    )
    text = (
        F.when(F.col("code").isin("P", "L", "S"), T.peel(F.when(F.col("code") == "S", F.regexp_extract("raw", T.SPEAKER, 2)).otherwise(value))["text"])
        .when(F.col("code") == "A", F.array_join(T.listed(value, ","), ","))
        .when(F.col("code") == "R", T.peel(value, image=False)["text"])
    )
    rows = rows.withColumn("code", F.when(keeps, code)).withColumn("said", text)
    shown = F.when((F.col("code") == "A") & (F.col("said") == ""), "a").otherwise(F.col("code"))
    opened = F.col("marker") == "LESSON"
    acts = rows.groupBy(*KEY, kind.alias("type")).agg(
        F.max(F.when(opened, 1)).alias("opened"), F.max(F.when(opened, T.or_null(F.col("title")))).alias("lesson"),
        F.max(F.when(F.col("ln") == F.col("act_ln"), T.or_null(F.col("title")))).alias("own"),
        F.sort_array(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("ln", shown.alias("code"), "name", F.col("said").alias("text"))))).alias("rows"),
    )
    items = F.when(F.col("type") == "DIALOGUE", _spoken()).when(F.col("type") == "SELECT", _cut(_SELECT, F.lit(""), "A", "a")).when(F.col("type") == "PRODUCE", _cut(_PRODUCE, F.lit(None), "R"))
    titles = F.create_map(*[F.lit(x) for kv in _TITLES.items() for x in kv])
    acts = acts.withColumn("items", items).withColumn("title", F.coalesce("own", F.element_at(titles, F.col("type"))))
    act = F.struct("act_no", "type", T.slug(F.concat_ws("-", "type", "title")).alias("id"), "title", F.when(F.size("items") > 0, F.col("items")).alias("items"))
    whole = acts.groupBy("doc", "lesson_no").agg(F.max("opened").alias("o"), F.max("lesson").alias("t"), F.sort_array(F.collect_list(F.when(F.col("act_no").isNotNull(), act))).alias("activities"))
    lesson = F.struct("lesson_no", *_lesson(F.col("o").isNull()), F.when(F.size("activities") > 0, F.col("activities")).alias("activities"))
    return whole.groupBy("doc").agg(F.sort_array(F.collect_list(lesson)).alias("lessons"))


def _cut(pattern: str, usual: Column, *answers: str) -> Column:
    """Items (no, prompt, answer) of an exercise's ``rows``; ``usual`` is the answer of an item that has none."""
    rows = F.col("rows")
    codes = F.array_join(F.col("rows.code"), "")
    made = F.regexp_extract_all(codes, F.lit(pattern), 0)
    number = F.flatten(F.transform(made, lambda s, k: F.array_repeat(k, F.length(s))))  # of each row behind the lead
    lead = F.length(F.regexp_extract(codes, "^[^PT]*", 0))

    def item(own: Column, k: Column) -> Column:
        last = lambda *of: F.try_element_at(F.filter(own, lambda r: r["code"].isin(*of)), F.lit(-1))["text"]
        return F.struct((k + 1).alias("no"), last("P").alias("prompt"), F.coalesce(last(*answers), usual).alias("answer"))

    def each(b: Column) -> Column:
        return F.transform(b["made"], lambda s, k: T.once(F.slice(rows, b["lead"] + F.array_position(b["number"], k).cast("int"), F.length(s)), lambda own: item(own, k)))

    return T.once(F.struct(made.alias("made"), number.alias("number"), lead.alias("lead")), each)


def _spoken() -> Column:
    """Lines (no, prompt, answer) of a dialogue's ``rows``: those with text, said by whoever was named last."""
    codes = F.array_join(F.col("rows.code"), "")
    runs = F.concat(F.array(F.regexp_extract(codes, "^L*", 0)), F.regexp_extract_all(codes, F.lit("SL*"), 0))
    names = F.concat(F.array(F.lit(None).cast("string")), F.filter("rows", lambda r: r["code"] == "S")["name"])
    who = F.flatten(F.transform(F.arrays_zip(runs.alias("run"), names.alias("name")), lambda x: F.array_repeat(x["name"], F.length(x["run"]))))
    full = F.filter(F.arrays_zip(F.col("rows.text").alias("text"), who.alias("who")), lambda x: x["text"] != "")
    return F.transform(full, lambda x, k: F.struct((k + 1).alias("no"), x["text"].alias("prompt"), x["who"].alias("answer")))


def voice_for(asked: DataFrame, spec: DataFrame) -> DataFrame:
    """doc, asked, voice of speakers by their name, then by their name in any case, then the default."""
    speakers = spec.where("slot = 'speaker'")
    exact = speakers.select("doc", F.col("speaker").alias("asked"), F.col("voice").alias("exact"))
    loose = speakers.groupBy("doc", F.lower("speaker").alias("key")).agg(F.min_by("voice", "speaker").alias("loose"))
    default = spec.where("slot = 'default'").select("doc", F.col("voice").alias("usual"))
    out = asked.join(exact, ["doc", "asked"], "left").withColumn("key", F.lower("asked")).join(loose, ["doc", "key"], "left").join(default, "doc", "left")
    return out.select("doc", "asked", F.coalesce("exact", "loose", "usual").alias("voice"))


def parse_course(docs: DataFrame) -> DataFrame:
    """doc, key, value of ``KEY: value`` files; comments and blanks skipped, the last of a key wins."""
    rows = lines(docs).withColumn("t", T.trim(F.col("raw"))).where("t <> '' AND NOT startswith(t, '#') AND instr(t, ':') > 1")
    colon = F.instr("t", ":")
    rows = rows.select("doc", "ln", T.trim(F.substring("t", F.lit(1), colon - 1)).alias("key"), T.trim(F.substring("t", colon + 1, F.length("t"))).alias("value"))
    return rows.groupBy("doc", "key").agg(F.max_by("value", "ln").alias("value"))
