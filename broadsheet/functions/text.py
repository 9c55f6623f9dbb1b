"""Text functions that do not depend on newspaper conventions."""

from __future__ import annotations

import functools
import html.entities
import json
import string
import unicodedata

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

# One whitespace character, as Unicode defines it (Java's \s alone is ASCII only).
SPACE = r"[\s\x0B\x1c-\x1f\x{85}\p{Z}]"
SPACES = "".join(c for c in map(chr, range(0x3001)) if c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85" or unicodedata.category(c) in ("Zs", "Zl", "Zp"))
# Found in every text of which ``strip`` leaves something; cheaper than the strip itself.
NOT_BLANK = "[^" + "".join(f"\\x{{{ord(c):x}}}" for c in SPACES) + "]"


def strip(text: Column) -> Column:
    """Trim all Unicode whitespace, not just blanks; in linear time, however long the blanks."""
    return F.btrim(text, F.lit(SPACES))


def _is_space(char: Column) -> Column:
    return char.isin(*SPACES)


def strip_named(text: Column) -> Column:
    """``strip`` of a column or lambda variable: it is named several times, but all whitespace is searched only where blanks are not all there is to trim."""
    bare = F.trim(text)
    rest = _is_space(F.substring(bare, 1, 1)) | _is_space(F.substring(bare, -1, 1))
    return F.when(rest, strip(bare)).otherwise(bare)


def squeeze(text: Column) -> Column:
    """Every whitespace run becomes one blank; ends trimmed."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def compact(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+", "")


def compact_len(text: Column) -> Column:
    return F.length(compact(F.coalesce(text, F.lit(""))))


def blank_to_null(text: Column) -> Column:
    """Trimmed text, null where nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def first_non_blank(*texts: Column, default: str | None = None) -> Column:
    """First text that is not blank, trimmed."""
    choices = [blank_to_null(t) for t in texts]
    if default is not None:
        choices.append(F.lit(default))
    return F.coalesce(*choices)


def count_matches(text: Column, pattern: str) -> Column:
    """Number of single characters of ``text`` in the character class ``pattern``."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, for places where no projection can hold it."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def once(make):
    """``make``, a function without arguments that builds Columns from column names, called once for each JVM.

    A large expression takes thousands of calls to the JVM; nothing in it depends on the session or the data.
    """
    made = {}

    @functools.wraps(make)
    def get():
        gateway = SparkContext._gateway
        if gateway not in made:
            made.clear()
            made[gateway] = make()
        return made[gateway]

    return get


#: A character reference as HTML reads it, semicolon or not.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: The same where only a semicolon ends one.
CLOSED_REFERENCE = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[^\t\n\f <&#;]{1,32});"
#: Names that HTML knows without a semicolon too, longest first.
_SHORT = {name for name in html.entities.html5 if not name.endswith(";")}
_LENGTHS = sorted({len(name) for name in _SHORT}, reverse=True)


def _numbers() -> dict[str, str]:
    """What numbers stand for that are no characters of their own: bytes of the Windows code page, and controls, which vanish."""
    def reading(n: int) -> str:
        try:
            return bytes([n]).decode("cp1252")
        except UnicodeDecodeError:
            return chr(n)

    controls = {n: "" for n in (*range(1, 9), 0x0B, *range(0x0E, 0x20), 0x7F)}
    return {str(n): c for n, c in (controls | {0: "\ufffd", 0x0D: "\r"} | {n: reading(n) for n in range(0x80, 0xA0)}).items()}


@once
def _entity_maps() -> dict[str, Column]:
    """Maps as one literal each, so that a plan does not carry thousands of nodes."""
    tables = {"names": html.entities.html5, "short": {n: html.entities.html5[n] for n in _SHORT}, "numbers": _numbers()}
    return {k: F.from_json(F.lit(json.dumps(v)), "map<string,string>") for k, v in tables.items()}


def _code_point(number: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def _numbered(name: Column) -> Column:
    """Character of a numeric reference such as ``#183`` or ``#xB7``."""
    hexadecimal = F.regexp_extract(name, "^#[xX]0*([0-9A-Fa-f]*)", 1)
    decimal = F.regexp_extract(name, "^#0*([0-9]*)", 1)
    digits = F.when(name.rlike("^#[xX]"), F.when(F.length(hexadecimal) <= 6, F.conv(F.concat(F.lit("0"), hexadecimal), 16, 10))).otherwise(
        F.when(F.length(decimal) <= 7, F.concat(F.lit("0"), decimal)))
    number = F.coalesce(digits.cast("long"), F.lit(0x110000))

    def character(n: Column) -> Column:
        none = ((n >= 0xFDD0) & (n <= 0xFDEF)) | F.pmod(n, F.lit(0x10000)).isin(0xFFFE, 0xFFFF)
        return (F.when((n > 0x10FFFF) | ((n >= 0xD800) & (n <= 0xDFFF)), F.lit("\ufffd"))
                .otherwise(F.coalesce(_entity_maps()["numbers"][n.cast("string")], F.when(none, F.lit("")).otherwise(_code_point(n)))))

    return let(number, character)


def _decoded(ref: Column, closed: bool) -> Column:
    """What a reference stands for: a number, a name, the longest short name it starts with (unless ``closed``), or itself."""
    def of(name: Column) -> Column:
        maps = _entity_maps()
        starts = [F.concat(maps["short"][F.substring(name, 1, n)], F.substr(name, F.lit(n + 1))) for n in _LENGTHS if not closed]
        return F.when(name.startswith("#"), _numbered(name)).otherwise(F.coalesce(maps["names"][name], *starts, ref))

    return let(F.substr(ref, F.lit(2)), of)


def unescape(text: Column, closed: bool = False) -> Column:
    """Decode the character references of HTML in one pass: what one decodes to is not read again.

    ``closed``: those that end in a semicolon alone, so that the ``&amp`` of a text cut short stays.
    """
    reference = CLOSED_REFERENCE if closed else REFERENCE

    def joined(t: Column) -> Column:
        pieces, refs = F.split(t, reference, -1), F.regexp_extract_all(t, F.lit(reference), F.lit(0))
        return let(refs, lambda found: F.array_join(F.transform(pieces, lambda p, i: F.concat(
            p, F.coalesce(_decoded(F.get(found, i), closed), F.lit("")))), ""))

    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), joined(t)).otherwise(t))


def _tidy_lines(text: Column) -> Column:
    out = F.regexp_replace(text, r"[ \t]+\n", "\n")
    out = F.regexp_replace(out, r"\n[ \t]+", "\n")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


BREAK_TAG = r"(?i)<\s*br\s*/?\s*>"
ANY_TAG = r"<[^>]+>"
BLOCK_END_TAG = r"(?i)</\s*(?:p|div|h[1-6]|li)\s*>"


def strip_markup(text: Column, closed: bool = False) -> Column:
    """Markup to text: breaks to newlines, any other tag to a blank."""
    def stripped(t: Column) -> Column:
        out = F.replace(unescape(t, closed), F.lit("\r"), F.lit("\n"))
        return _tidy_lines(F.regexp_replace(F.regexp_replace(out, BREAK_TAG, "\n"), ANY_TAG, " "))

    def marked(t: Column) -> Column:
        return functools.reduce(lambda a, b: a | b, [F.contains(t, F.lit(c)) for c in "<&\n\r"])

    # Most lines hold nothing that the patterns below could match; a search for four characters costs far less than six patterns.
    return let(F.coalesce(text, F.lit("")), lambda t: F.when(marked(t), stripped(t)).otherwise(strip(t)))


def clean_extracted_text(text: Column, closed: bool = False) -> Column:
    """Markup to text: breaks and block ends to newlines, any other tag to nothing."""
    out = F.replace(unescape(F.coalesce(text, F.lit("")), closed), F.lit("\r"), F.lit("\n"))
    out = F.regexp_replace(F.regexp_replace(out, BREAK_TAG, "\n"), BLOCK_END_TAG, "\n")
    return _tidy_lines(F.regexp_replace(out, ANY_TAG, ""))


def fragment_to_text(text: Column, closed: bool = False) -> Column:
    """Markup to text with table cells separated by tabs and rows by newlines."""
    out = F.regexp_replace(unescape(text, closed), BREAK_TAG, "\n")
    out = F.regexp_replace(out, r"(?i)</\s*(?:td|th)\s*>\s*<\s*(?:td|th)\b[^>]*>", "\t")
    out = F.regexp_replace(out, r"(?i)</\s*tr\s*>", "\n")
    out = unescape(F.regexp_replace(out, ANY_TAG, ""), closed)
    return _tidy_lines(F.regexp_replace(out, r"\r\n?", "\n"))


def normalize_text(text: Column, closed: bool = False) -> Column:
    """Markup removed and all whitespace reduced to single blanks."""
    return squeeze(strip_markup(text, closed))


def display_text(text: Column) -> Column:
    """One display line: markup removed, leading heading and list marks dropped."""
    out = F.regexp_replace(unescape(strip(F.coalesce(text, F.lit("")))), BREAK_TAG, "\n")
    out = F.regexp_replace(out, ANY_TAG, " ")
    return squeeze(F.regexp_replace(out, rf"^(?:[#>\-]|{SPACE})+", ""))


def display_title(*texts: Column) -> Column:
    return F.coalesce(*[F.nullif(display_text(t), F.lit("")) for t in texts], F.lit("Untitled"))


def escape_html(text: Column) -> Column:
    out = text
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


# -- slugs -----------------------------------------------------------------------------------

#: Digits and ASCII letters one by one: Java looks a class of single characters up in one table, but tries its ranges one after the other.
ALNUM = string.digits + string.ascii_letters


def slugify(text: Column, default: str = "document") -> Column:
    """Path-safe slug: runs of other characters and dashes to one ``-``, ends freed of marks."""
    out = F.btrim(F.regexp_replace(strip(text), f"[^{ALNUM}._]+", "-"), F.lit("-._"))
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(default))


def slug_field_name(text: Column) -> Column:
    """Field key of a label: lower-case ASCII letters, digits and ``_``."""
    out = F.btrim(F.regexp_replace(F.lower(strip(text)), f"[^{string.digits}{string.ascii_lowercase}_]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("field"))


def normalize_reviewer(text: Column) -> Column:
    out = F.regexp_replace(strip(F.coalesce(text, F.lit(""))), rf"[^{ALNUM}._\-가-힣]+", "_")
    return F.coalesce(F.nullif(F.btrim(out, F.lit("._-")), F.lit("")), F.lit("reviewer"))


# -- script ratios ---------------------------------------------------------------------------

def hangul_count(text: Column) -> Column:
    return count_matches(text, "[가-힣]")


def hangul_ratio_letters(text: Column) -> Column:
    """Hangul share of Hangul, Latin and CJK letters."""
    hangul = hangul_count(text)
    total = hangul + count_matches(text, "[A-Za-z]") + count_matches(text, r"[\x{4e00}-\x{9fff}]")
    return F.when(total > 0, hangul / total).otherwise(F.lit(0.0))


def hangul_ratio_all(text: Column) -> Column:
    """Hangul share of all non-space characters, four decimals."""
    total = compact_len(text)
    return F.when(total > 0, F.round(hangul_count(text) / total, 4)).otherwise(F.lit(0.0))


# -- pieces ----------------------------------------------------------------------------------

def page_range(text: Column) -> Column:
    """Zero-based page numbers of ``0-2,5``; null where blank, an error where not ascending."""
    tokens = F.filter(F.transform(F.split(text, ","), strip), lambda t: t != "")

    def expand(token: Column) -> Column:
        # A dash anywhere makes a range, so a negative number fails to read as one.
        parts = F.transform(F.split(token, "-", 2), lambda p: strip(p).try_cast("int"))
        start, end = F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))
        bad = F.exists(parts, F.isnull) | (end < start)
        message = F.lit("page_range must use ascending zero-based page indexes")
        return F.when(bad, F.raise_error(message).cast("array<int>")).otherwise(F.sequence(start, end))

    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(tokens, expand))))
    return F.when(F.coalesce(text, F.lit("")) != "", pages)


def truncate_text(text: Column, limit: int) -> Column:
    # The end is trimmed after the cut alone, which leaves the same: a blank end of the whole text is cut off or trimmed then.
    start = F.ltrim(F.coalesce(text, F.lit("")))
    start = F.when(_is_space(F.substring(start, 1, 1)), F.ltrim(start, F.lit(SPACES))).otherwise(start)
    cut = F.rtrim(F.substring(start, 1, limit))
    return F.when(_is_space(F.substring(cut, -1, 1)), F.rtrim(cut, F.lit(SPACES))).otherwise(cut)


def normalize_issue_date(text: Column) -> Column:
    """ISO date, or the first ten characters of what does not read as one: the first ten in either case, as ``yyyy-MM-dd`` reads back as itself."""
    return F.substring(strip(F.coalesce(text, F.lit(""))), 1, 10)


def normalize_score(value: Column) -> Column:
    """Score in 0..1; values above 1 and up to 100 are percents; null where it is no number."""
    score = strip(value.cast("string")).try_cast("double")
    score = F.when((score > 1.0) & (score <= 100.0), score / 100.0).otherwise(score)
    return F.when(score.isNotNull(), F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def coerce_score(value: Column) -> Column:
    return F.coalesce(normalize_score(value), F.lit(0.0))


def clean_article_text(text: Column, limit: int | None = None, keep_newlines: bool = False, closed: bool = False) -> Column:
    """Entity-free article text on one line, or line by line without the empty ones."""
    out = F.replace(unescape(F.coalesce(text, F.lit("")), closed), F.lit("\r"), F.lit("\n"))
    if keep_newlines:
        lines = F.filter(F.transform(F.split(out, "\n"), squeeze), lambda line: line != "")
        out = F.array_join(lines, "\n")
    else:
        out = squeeze(out)
    return strip(F.substring(out, 1, limit)) if limit is not None else out


def non_empty_lines(text: Column) -> Column:
    """Trimmed lines that hold something."""
    lines = F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n")
    return F.filter(F.transform(lines, strip), lambda line: line != "")


# -- tables ----------------------------------------------------------------------------------

def table_rows_from_html(html: Column, clean=clean_extracted_text) -> Column:
    """``<tr>`` rows of non-empty cell texts; rows with fewer than two such cells are dropped."""
    rows = F.regexp_extract_all(unescape(F.coalesce(html, F.lit(""))),
                                F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))

    def cells(row: Column) -> Column:
        found = F.regexp_extract_all(row, F.lit(r"(?is)<(?:td|th)\b[^>]*>(.*?)</(?:td|th)>"), F.lit(1))
        return F.filter(F.transform(found, lambda cell: clean(cell)), lambda cell: cell != "")

    return F.filter(F.transform(rows, cells), lambda row: F.size(row) > 1)


def table_rows_from_json(payload: Column) -> Column:
    """Rows given as lists, or as objects holding ``cells``, ``columns`` or ``values``."""
    rows = F.from_json(payload, "array<string>")

    def cells(row: Column) -> Column:
        named = F.coalesce(*[
            F.when(F.size(F.from_json(F.get_json_object(row, f"$.{key}"), "array<string>")) > 0,
                   F.from_json(F.get_json_object(row, f"$.{key}"), "array<string>"))
            for key in ("cells", "columns", "values")])
        listed = F.when(F.startswith(row, F.lit("[")), F.from_json(row, "array<string>")).otherwise(named)
        cleaned = F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda cell: clean_extracted_text(cell))
        return F.filter(cleaned, lambda cell: cell != "")

    return F.filter(F.transform(rows, cells), lambda row: F.size(row) > 1)


def rows_to_tsv(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda row: F.array_join(row, "\t")), "\n")


def rows_to_markdown_table(rows: Column, min_columns: int = 2) -> Column:
    """Pipe table padded to the widest row; blank where it has fewer than ``min_columns``."""
    clean = F.transform(rows, lambda row: F.transform(row, lambda c: strip(F.replace(c, F.lit("|"), F.lit("\\|")))))
    clean = F.filter(clean, lambda row: F.exists(row, lambda c: c != ""))

    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def render(table: Column, width: Column) -> Column:
        padded = F.transform(table, lambda row: line(F.concat(row, F.array_repeat(F.lit(""), width - F.size(row)))))
        rule = line(F.array_repeat(F.lit("---"), width))
        text = let(padded, lambda p: F.array_join(F.concat(F.slice(p, 1, 1), F.array(rule), F.slice(p, 2, 1 << 30)), "\n"))
        return F.when((F.size(table) > 0) & (width >= min_columns), text).otherwise(F.lit(""))

    return let(clean, lambda table: let(
        F.coalesce(F.array_max(F.transform(table, F.size)), F.lit(0)), lambda width: render(table, width)))


# -- Markdown and replies --------------------------------------------------------------------

def markdown_to_html(markdown: Column) -> Column:
    """``#`` lines to headings, other non-blank lines to paragraphs."""

    def render(line: Column) -> Column:
        marks = F.length(F.regexp_extract(line, "^(#*)", 1))
        level = F.least(marks, F.lit(6)).cast("string")
        heading = F.concat(F.lit("<h"), level, F.lit(">"), escape_html(strip(F.substr(line, F.least(marks, F.lit(6)) + 1))),
                           F.lit("</h"), level, F.lit(">"))
        paragraph = F.concat(F.lit("<p>"), escape_html(line), F.lit("</p>"))
        return F.when(marks > 0, heading).otherwise(paragraph)

    lines = F.filter(F.transform(F.split(markdown, r"\r\n|[\n\r]"), strip), lambda line: line != "")
    return F.when(F.size(lines) > 0, F.array_join(F.transform(lines, render), "\n")).otherwise(F.lit("<p></p>"))


def markdown_body(markdown: Column) -> Column:
    """Text after the title and its bullet metadata, up to ``## Images``; all of it if untitled."""
    lines = F.split(F.replace(markdown, F.lit("\r"), F.lit("")), "\n")
    numbered = F.transform(lines, lambda line, i: F.struct(i.alias("i"), line.alias("line"), strip(line).alias("bare")))

    def first(rows: Column, condition) -> Column:
        return F.array_min(F.transform(F.filter(rows, condition), lambda s: s["i"]))

    def is_metadata(bare: Column) -> Column:
        return F.startswith(bare, F.lit("- ")) & F.contains(F.substr(bare, F.lit(3)), F.lit(":"))

    def text_of(rows: Column) -> Column:
        start = first(rows, lambda s: (s["bare"] != "") & ~is_metadata(s["bare"]))
        kept = let(start, lambda at: F.filter(rows, lambda s: s["i"] >= at))
        return F.coalesce(strip(F.array_join(F.transform(kept, lambda s: s["line"]), "\n")), F.lit(""))

    def below(rows: Column, title: Column) -> Column:
        after = F.filter(rows, lambda s: s["i"] > title)
        end = let(after, lambda a: first(a, lambda s: s["bare"] == "## Images"))
        return let(end, lambda e: let(F.filter(after, lambda s: e.isNull() | (s["i"] < e)), text_of))

    body = let(numbered, lambda rows: let(
        first(rows, lambda s: F.startswith(s["bare"], F.lit("#"))), lambda title: F.when(title.isNotNull(), below(rows, title))))
    return F.coalesce(body, strip(markdown))


def reply_json(reply: Column) -> Column:
    """JSON object inside a model reply: code fence removed, cut to the outer braces."""
    text = strip(F.coalesce(reply, F.lit("")))
    text = F.when(
        F.startswith(text, F.lit("```")),
        F.regexp_replace(F.regexp_replace(text, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")).otherwise(text)

    def cut(t: Column) -> Column:
        braces = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
        return F.when(~F.startswith(t, F.lit("{")) & (braces != ""), braces).otherwise(t)

    return let(let(text, cut), lambda t: F.when(F.startswith(t, F.lit("{")) & F.try_parse_json(t).isNotNull(), t))


def classify_error(message: Column) -> Column:
    """Error code of a failure message; the first keyword that occurs decides."""
    low = F.lower(message)

    def has(word: str) -> Column:
        return F.contains(low, F.lit(word))

    return (
        F.when(has("pdf"), "invalid_pdf")
        .when(has("page_range") | has("max_pages") | has("page_number"), "invalid_request")
        .when(has("not found"), "input_not_found")
        .otherwise("processing_failed")
    )
