"""String and number expressions of the lesson format. All are built of JVM functions, without UDFs.

White space means what the format's original language trims: ASCII and Unicode spaces, the byte order mark included.
Rounding is floor(x + 0.5).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\t\n\x0B\f\r    -     　﻿]"
_TOKEN = rf"(?s)^(.*?){SPACE}*\{{{SPACE}*([^{{}}]+?){SPACE}*\}}$"
# File extensions of the two kinds of inline assets.
AUDIO = r"(?i)\.(?:mp3|wav|ogg|opus|m4a)$"
IMAGE = r"(?i)\.(?:jpe?g|png|gif|webp|svg)$"
FIELD = rf"^([A-Z_]+):{SPACE}*(.*)?$"
SPEAKER = rf"^([A-Za-z][A-Za-z0-9_]*):{SPACE}*(.*)$"
IDENTIFIER = r"^[A-Za-z][A-Za-z0-9_]*$"


def trim_end(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+$", "")


def trim_start(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+", "")


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def or_null(c: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(c, F.lit(""))


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, edges trimmed (P20)."""
    return trim(F.regexp_replace(c, f"{SPACE}+", " "))


def once(value: Column, build: Callable[[Column], Column]) -> Column:
    """What ``build`` makes of a value that it names more than once and that is worked out once."""
    return F.transform(F.array(value), build)[0]


def slug(c: Column) -> Column:
    """Lower case, other than a-z0-9 to one dash, a dash at either edge dropped."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def nearest(c: Column, digits: int = 0) -> Column:
    """Rounds half up."""
    scale = 10**digits
    return F.floor(c * scale + 0.5) / scale if digits else F.floor(c + 0.5)


def clamp(low, x: Column, high) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def read_seconds(text: Column) -> Column:
    """Time to read a text: 1.2 s and 0.32 s a word, between 2.2 and 8."""
    words = F.size(F.filter(F.split(squeeze(text), " "), lambda w: w != ""))
    return clamp(2.2, 1.2 + words * 0.32, 8.0)


def _file(token: Column) -> Column:
    """A token's file, without any @start-end."""
    return trim(F.split(token, "@", -1)[0])


def peel(value: Column, audio: bool = True, image: bool = True) -> Column:
    """struct(text, audio, image): trailing ``{file}`` tokens, at most one of each kind (P04). The loop ends after two
    successes, so it is a fold of two passes; each takes the last token if its kind is allowed and still free. Texts
    that don't end with a brace skip it."""
    text = trim(value)
    state = F.struct(text.alias("text"), F.lit(None).cast("string").alias("audio"), F.lit(None).cast("string").alias("image"))
    folded = F.aggregate(F.array(F.lit(1), F.lit(2)), state, lambda s, _: _pass(s, audio, image))
    return F.when(text.endswith("}"), folded).otherwise(state)


def _pass(s: Column, audio: bool, image: bool) -> Column:
    def taken(file: Column) -> Column:  # empty without a token
        is_audio = F.lit(audio) & s["audio"].isNull() & file.rlike(AUDIO)
        is_image = F.lit(image) & s["image"].isNull() & file.rlike(IMAGE) & ~is_audio
        return F.struct(
            F.when(is_audio | is_image, trim(F.regexp_extract(s["text"], _TOKEN, 1))).otherwise(s["text"]).alias("text"),
            F.when(is_audio, file).otherwise(s["audio"]).alias("audio"),
            F.when(is_image, file).otherwise(s["image"]).alias("image"),
        )

    return once(_file(F.regexp_extract(s["text"], _TOKEN, 2)), taken)


def asset_facts(value: Column) -> Column:
    """struct(total, trailing, audio, image): assets anywhere, and in the run of tokens at the end."""
    token = rf"\{{{SPACE}*([^{{}}]+?){SPACE}*\}}"
    is_asset = lambda t: _file(t).rlike(AUDIO) | _file(t).rlike(IMAGE)
    total = F.size(F.filter(F.regexp_extract_all(value, F.lit(token), 1), is_asset))
    run = F.regexp_extract(trim_end(value), rf"((?:\{{[^{{}}]+\}}{SPACE}*)*)$", 1)
    tokens = F.reverse(F.regexp_extract_all(run, F.lit(token), 1))
    known = F.transform(tokens, is_asset)
    first_other = F.array_position(known, F.lit(False))
    last = F.slice(tokens, F.lit(1), F.when(first_other > 0, (first_other - 1).cast("int")).otherwise(F.size(tokens)))
    count = lambda kind: F.size(F.filter(last, lambda t: _file(t).rlike(kind)))
    return F.struct(total.alias("total"), F.size(last).alias("trailing"), count(AUDIO).alias("audio"), count(IMAGE).alias("image"))


def speaker_of(line: Column) -> Column:
    """The speaker of a screenplay line: an identifier with a lower-case ASCII letter before a colon; else null."""
    name = F.regexp_extract(line, SPEAKER, 1)
    return F.when(name.rlike("[a-z]"), name)


def option_of(value: Column) -> Column:
    """struct(id, value) of an option; null without a pipe."""
    parts = F.transform(F.split(value, r"\|", -1), trim)
    return F.when(F.size(parts) >= 2, F.struct(parts[0].alias("id"), F.array_join(F.slice(parts, F.lit(2), F.size(parts)), " | ").alias("value")))


def listed(value: Column, separator: str) -> Column:
    """Trimmed parts that are not empty."""
    return F.filter(F.transform(F.split(value, separator, -1), trim), lambda x: x != "")


def voice_of(value: Column) -> Column:
    """struct(voice, prompt) of ``voice | style`` (P10); null where nothing stands before the pipe."""
    pattern = rf"(?s)^([^|]+)(?:{SPACE}*\|{SPACE}*(.*))?$"
    return F.when(value.rlike(pattern), F.struct(trim(F.regexp_extract(value, pattern, 1)).alias("voice"), or_null(trim(F.regexp_extract(value, pattern, 2))).alias("prompt")))


def input_mode(value: Column) -> Column:
    """``type``, or ``speak`` for anything else."""
    return F.when(F.lower(trim(value)) == "type", "type").otherwise("speak")


def check_mode(value: Column) -> Column:
    """``exact``, ``llm``, or ``reveal`` for anything else."""
    v = F.lower(trim(value))
    return F.when(v.isin("exact", "llm"), v).otherwise("reveal")


# Number words that may stand after "Number".
NUMBER_WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twenty-one twenty-two twenty-three twenty-four".split()


def item_number(text: Column) -> Column:
    """The number at the start of "Number 5 ..." or "Number five ..."; null without."""
    word = F.lower(F.regexp_extract(text, rf"(?i)^{SPACE}*number{SPACE}+([\w-]+)\b", 1))
    known = F.create_map(*[F.lit(x) for k, w in enumerate(NUMBER_WORDS) for x in (w, k + 1)])
    return F.when(word.rlike(r"^\d+$"), word.try_cast("int")).otherwise(F.try_element_at(known, word))


def image_refs(text: Column) -> Column:
    """array of struct(filename, page, idx, panel, caption) for ``![#N caption](images/page_P_I.jpg)``; doubled brackets
    are stripped, panel numbers have three digits at most (P22)."""
    pattern = r"!\[(.*?)\]\(images/(page_(\d+)_(\d+)\.(?:png|jpe?g))\)"
    alt, name, page, idx = (F.regexp_extract_all(text, F.lit(pattern), k) for k in (1, 2, 3, 4))
    made = F.arrays_zip(alt.alias("alt"), name.alias("name"), page.alias("page"), idx.alias("idx"))

    def row(x: Column) -> Column:
        bare = F.regexp_replace(x["alt"], r"^\[+|\]+$", "")
        return F.struct(x["name"].alias("filename"), x["page"].cast("int").alias("page"), x["idx"].cast("int").alias("idx"), or_null(F.regexp_extract(bare, r"^#(\d{1,3})\b", 1)).cast("int").alias("panel"), F.regexp_replace(bare, rf"^#\d+{SPACE}*", "").alias("caption"))

    return F.transform(made, row)


def clip_parts(name: Column) -> Column:
    """struct(lesson, fig) of a clip's file name; null where it is none."""
    pattern = r"(?i)^bk\w+-l(\d+[a-d])-f(\d+)-.+\.mp3$"
    return F.when(name.rlike(pattern), F.struct(F.upper(F.regexp_extract(name, pattern, 1)).alias("lesson"), F.regexp_extract(name, pattern, 2).cast("int").alias("fig")))


def clip_base(book: Column, lesson: Column, fig: Column) -> Column:
    """The common start of a figure's clip names."""
    return F.concat(F.lit("bk"), book.cast("string"), F.lit("-l"), F.lower(lesson), F.lit("-f"), fig.cast("string"))


def spoken(line: Column) -> Column:
    """What a line says: without tokens, an option's id, or the field or speaker before the colon."""
    bare = trim(F.regexp_replace(line, r"\{[^{}]*\}", " "))
    option, field = rf"^OPTION:{SPACE}*[^|]+\|{SPACE}*(.*)$", rf"^[A-Za-z][A-Za-z0-9_]*:{SPACE}*(.*)$"
    return trim(F.when(bare.rlike(option), F.regexp_extract(bare, option, 1)).when(bare.rlike(field), F.regexp_extract(bare, field, 1)).otherwise(bare))


def token_key(word: Column) -> Column:
    """What words are aligned by."""
    return F.regexp_replace(F.lower(word), "[^a-z0-9']", "")


# English number words.
_ONES = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
_TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]


def _in_words(n: int) -> str:
    return _ONES[n] if n < 20 else _TENS[n // 10 - 2] + (f" {_ONES[n % 10]}" if n % 10 else "")


def spoken_tokens(text: Column) -> Column:
    """Words of a text as they are spoken (P25): ``6:30`` and runs of three or four digits as clock times, one or two
    digits as numbers, then only letters and inner apostrophes. Times and numbers are marked off by control
    characters and looked up in a literal map."""
    names = F.create_map(*[F.lit(x) for n in range(100) for x in (n, _in_words(n))])
    marked = F.regexp_replace(F.lower(text), r"(\d{1,2}):(\d{2})", "\u0001$1\u0002$2\u0001")
    marked = F.regexp_replace(marked, r"(?<!\u0002)\b(\d{1,2})([0-5]\d)\b(?!\u0002)", "\u0001$1\u0002$2\u0001")
    marked = F.regexp_replace(marked, r"(?<!\u0002)\b(\d{1,2})\b(?!\u0002)", "\u0001$1\u0001")

    def say(part: Column) -> Column:
        hour, minute = (F.get(F.split(part, "\u0002"), F.lit(k)).try_cast("int") for k in (0, 1))
        clock = F.concat_ws(" ", F.try_element_at(names, hour), F.when(minute == 0, "o'clock").otherwise(F.try_element_at(names, minute)))
        return F.when(part.contains("\u0002"), clock).otherwise(F.coalesce(F.try_element_at(names, F.when(part.rlike(r"^\d{1,2}$"), part).try_cast("int")), part))

    pieces = F.array_join(F.transform(F.split(marked, "\u0001"), say), "")
    words = F.split(F.regexp_replace(pieces, "[^a-z']+", " "), " ")
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, "^'+|'+$", "")), lambda w: w != "")


def file_title(heading: Column) -> Column:
    """A heading as a file name: slashes and white space to one space, other characters dropped, 80 at most."""
    return F.substring(squeeze(F.regexp_replace(F.regexp_replace(heading, r"[/\\]+", " "), r"[^A-Za-z0-9 _.\-]", "")), 1, 80)


def padded(n: Column, width: int = 3) -> Column:
    """Zeros in front up to a width; longer numbers stay whole."""
    s = n.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 11th."""
    teen = (n % 100).between(11, 13)
    end = F.when(teen, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def last_number(name: Column) -> Column:
    """The last digits before a file name's extension."""
    return F.regexp_extract(name, r"(\d+)(?=\D*$)", 1).try_cast("int")


def escape_html(c: Column) -> Column:
    """Four replacements, the ampersand first."""
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def version_parts(v: Column) -> Column:
    """Three numbers; missing ones are 0 (P46). Arrays compare in order."""
    parts = F.split(F.regexp_replace(v, "^v", ""), r"\.")
    return F.array(*[F.coalesce(F.get(parts, F.lit(k)).try_cast("int"), F.lit(0)) for k in range(3)])


# Language codes and names.
LANGUAGES = {"en": "English", "fr": "French", "de": "German", "es": "Spanish", "it": "Italian", "pt": "Portuguese", "ru": "Russian", "ja": "Japanese", "zh": "Chinese", "ko": "Korean", "ar": "Arabic", "tr": "Turkish"}


def language_name(code: Column) -> Column:
    """A code's name, else the code."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), code), code)


def strip_fence(c: Column) -> Column:
    """Without one code fence at the start and one at the end."""
    return trim(F.regexp_replace(F.regexp_replace(trim(c), r"^```[A-Za-z]*\s*\n?", ""), r"\n?```\s*$", ""))


def json_span(c: Column) -> Column:
    """From the first [ to the last ] (P19); null without."""
    start, end = F.instr(c, "["), F.length(c) - F.instr(F.reverse(c), "]") + 1
    return F.when((start > 0) & (F.instr(c, "]") > 0) & (end >= start), F.substring(c, start, end - start + 1))


def split_sections(c: Column, marker: str) -> Column:
    """Parts between full-line markers, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(c, f"(?im)^{marker}$", -1), trim), lambda x: x != "")


def asset_path(name: Column, folder: str = "module/") -> Column:
    """URLs as they are, without leading ./ and ../, bare names below a folder."""
    bare = F.regexp_replace(name, r"^(?:\.{1,2}/)+", "")
    return F.when(name.rlike("^(?i)(?:https?|data|file):"), name).when(bare.contains("/"), bare).otherwise(F.concat(F.lit(folder), bare))


def cache_key(*parts: Column) -> Column:
    """The first 12 hex digits of a SHA-1."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12)


def box_region(box: Column, width: Column, height: Column, grow: float = 0.0) -> Column:
    """struct(x, y, w, h) in pixels of a box [ymin, xmin, ymax, xmax] on 0..1000, grown about its centre and clamped;
    null where it is empty (P36)."""
    edge = lambda lo, hi, sign: clamp(0.0, (box[lo] + box[hi]) / 2 + sign * ((box[hi] - box[lo]) * (1 + grow)) / 2, 1000.0)
    x, y = (nearest(edge(a, b, -1) / 1000 * size) for a, b, size in ((1, 3, width), (0, 2, height)))
    w, h = (nearest((edge(a, b, 1) - edge(a, b, -1)) / 1000 * size) for a, b, size in ((1, 3, width), (0, 2, height)))
    return F.when((w > 0) & (h > 0), F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")))


def png_size(content: Column) -> Column:
    """struct(width, height) from a PNG header."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
    return F.struct(number(17).alias("width"), number(21).alias("height"))


def occurrences(c: Column, pattern: str) -> Column:
    """How often a pattern occurs."""
    return F.regexp_count(c, F.lit(pattern))


def _table_row(line: Column) -> Column:
    """A ``|a|b|`` line as a table row, nothing for a rule line, other lines as they are."""
    cells = F.transform(F.filter(F.split(line, r"\|", -1), lambda x: trim(x) != ""), trim)
    row = F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>"))), ""), F.lit("</tr>"))
    return F.when(~line.rlike(r"^\|.+\|$"), line).when(F.forall(cells, lambda x: x.rlike("^[-:]+$")), "").otherwise(row)


def markdown_html(c: Column, resolve=lambda src: src) -> Column:
    """Markdown notes as HTML, by the passes of the preview (P43): images are set aside and put back at the end, the rest is
    escaped, then phrases, headings, bold, italics, lists, tables and paragraphs are marked in this order."""
    image = r"!\[([^\]]*)\]\(([^)]+)\)"
    tag = lambda i: F.concat(F.lit('<img class="md-img" src="'), escape_html(resolve(F.regexp_extract(i, image, 2))), F.lit('" alt="'), escape_html(F.regexp_extract(i, image, 1)), F.lit('" />'))
    images = F.transform(F.regexp_extract_all(c, F.lit(image), 0), tag)
    mark = lambda k: F.concat(F.lit("@@IMG"), k.cast("string"), F.lit("@@"))
    html = F.array_join(F.transform(F.split(c, image, -1), lambda part, k: F.concat(F.when(k > 0, mark(k - 1)).otherwise(""), part)), "")
    html = escape_html(html)
    for pattern, new in (
        (r"\{([^}]+)\}", '<span class="audio-phrase">$1</span>'), (r"(?m)^### (.+)$", "<h5>$1</h5>"), (r"(?m)^## (.+)$", "<h4>$1</h4>"), (r"\*\*(.+?)\*\*", "<strong>$1</strong>"),
        (r"\*(.+?)\*", "<em>$1</em>"), (r"(?m)^- (.+)$", "<li>$1</li>"), (r"(<li>.*</li>\n?)+", "<ul>$0</ul>"),
    ):
        html = F.regexp_replace(html, pattern, new)
    html = F.array_join(F.transform(F.split(html, "\n", -1), _table_row), "\n")
    html = F.regexp_replace(F.regexp_replace(html, r"(<tr>.*</tr>\n?)+", "<table>$0</table>"), r"\n\n+", "</p><p>")
    html = F.concat(F.lit("<p>"), html, F.lit("</p>"))
    for pattern, new in (
        (r"<p>\s*</p>", ""), (r"<p>\s*(<h[45]>)", "$1"), (r"(</h[45]>)\s*</p>", "$1"), (r"<p>\s*(<ul>)", "$1"), (r"(</ul>)\s*</p>", "$1"), (r"<p>\s*(<table>)", "$1"), (r"(</table>)\s*</p>", "$1"),
    ):
        html = F.regexp_replace(html, pattern, new)
    put = F.aggregate(images, F.struct(html.alias("t"), F.lit(0).alias("k")), lambda a, i: F.struct(F.replace(a["t"], mark(a["k"]), i).alias("t"), (a["k"] + 1).alias("k")))
    return put["t"]
