"""Text expressions: HTML to text, occurrence counts, trims and fallbacks.

Everything here is a ``Column`` built from Spark's own functions, so it runs
inside the JVM next to the scan.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, functions as F

# The characters ``str.strip`` and the regex class ``\s`` treat as
# white space in Python text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a Java class. Lone spaces between words are already what they
# should become, so only other runs match and most text passes unreplaced.
_UNEVEN_RUN = r"(?U)[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*+| [\s\x1c-\x1f]++"

# Stands where markup was until entities are decoded, so that an entity cut off
# by a tag keeps its end. U+FDD0 is a noncharacter and never part of a text.
_CUT = "\ufdd0"

# One left-to-right pass, in the order a tokenizer meets things: comments,
# CDATA (its text stays, as group 1), elements whose text is never shown,
# declarations and processing instructions, end tags, start tags with quoted
# attribute values. What never closes runs to the end of the text, so that no text is
# searched twice for the same end. The shared "<" in front lets the matcher skip plain text
# fast; the possessive loop keeps Java from recursing on long tags.
_MARKUP = (
    r"(?is)<(?:!\[CDATA\[(.*?)(?:\]\]>|\z)"
    r"|(script|style|template)(?=[\s/>])[^>]*>.*?(?:</\2\s*>|\z)"
    r"|(rt|rp)(?=[\s/>])[^>]*>.*?(?=</(?:\3|ruby)\s*>|\z)"
    r"|(?:!(?!--)|\?)[^>]*>"
    r"|/[^>]*>"
    r"""|[a-z](?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>)"""
)
# The same with comments in front. A comment that never closes matches with all that
# follows (group 4), so that the text is searched for its end once only.
_COMMENT_OR_MARKUP = _MARKUP.replace("<", r"<(?:!--.*?-->|", 1) + r")|(<!--.*)\z"

# A reference needs one more character after it; a closing semicolon is eaten.
_REFERENCE = (
    "&(?:[a-zA-Z][-.a-zA-Z0-9]*(?=[^a-zA-Z0-9])"
    "|#(?:[0-9]+|[xX][0-9a-fA-F]+)(?=[^0-9a-fA-F]));?"
)

_COMMON_NAMES = ("amp", "quot", "nbsp", "lt", "gt", "apos", "copy", "middot")


def _entity_names() -> str:
    """All named references as JSON objects by their first and second letter.

    A map lookup in Spark walks the entries in order, so the maps are kept short and
    the frequent names come first.
    """
    letters: dict[str, dict[str, dict[str, str]]] = {}
    for name in (*_COMMON_NAMES, *(n.rstrip(";") for n in html5)):
        text = html5.get(name + ";", html5.get(name))
        letters.setdefault(name[0], {}).setdefault(name[1], {}).setdefault(name, text)
    return json.dumps(letters)


_ENTITY_JSON = _entity_names()

# References below 256 are read as windows-1252 bytes where that page has them.
_WINDOWS_1252 = {
    code: bytes([code]).decode("windows-1252")
    for code in range(0x80, 0xA0)
    if code not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)
}
_WINDOWS_1252_JSON = json.dumps({str(code): text for code, text in _WINDOWS_1252.items()})


def _code_point(code: Column) -> Column:
    """The character with this number, U+FFFD where there is none."""
    valid = code.isNotNull() & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    padded = F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD)), 8, "0")
    return F.decode(F.unhex(padded), "UTF-32")


def _decode_reference(ref: Column) -> Column:
    body = F.rtrim(F.substring(ref, 2, 1 << 30), F.lit(";"))
    digits = F.substring(body, 2, 1 << 30)
    is_hex = F.lower(F.substring(digits, 1, 1)) == "x"
    # Longer digit strings than these are past the last code point anyway.
    hex_digits = F.ltrim(F.substring(digits, 2, 1 << 30), F.lit("0"))
    dec_digits = F.ltrim(digits, F.lit("0"))
    code = F.when(
        is_hex,
        F.when(F.length(hex_digits) <= 6,
               F.conv(F.concat(F.lit("0"), hex_digits), 16, 10).cast("long")),
    ).otherwise(
        F.when(F.length(dec_digits) <= 7, F.concat(F.lit("0"), dec_digits).cast("long")))
    windows = F.from_json(F.lit(_WINDOWS_1252_JSON), "map<string,string>")
    letters = F.from_json(F.lit(_ENTITY_JSON), "map<string,map<string,map<string,string>>>")
    named = F.try_element_at(F.try_element_at(letters, F.substring(body, 1, 1)), F.substring(body, 2, 1))
    return F.when(
        F.startswith(body, F.lit("#")),
        F.coalesce(F.try_element_at(windows, code.cast("string")), _code_point(code)),
    ).otherwise(F.coalesce(F.try_element_at(named, body), F.concat(F.lit("&"), body)))


def with_value(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often it is used.

    Common subexpressions are not shared across branches and lambdas, so a
    costly value is bound to a lambda variable instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def decode_entities(text: Column) -> Column:
    """Named and numeric character references decoded once, left to right.

    An unknown name keeps its ampersand and name; as in the usual parser stack
    its semicolon is dropped. A reference at the very end of the text with no
    semicolon stays as written.
    """
    def decoded(t: Column) -> Column:
        pieces = F.zip_with(
            F.split(t, _REFERENCE, -1),
            F.regexp_extract_all(t, F.lit(_REFERENCE), 0),
            lambda kept, ref: F.concat(
                kept, F.when(ref.isNotNull(), _decode_reference(ref)).otherwise("")))
        return F.when(F.contains(t, F.lit("&")), F.array_join(pieces, "")).otherwise(t)

    return with_value(text, decoded)


def html_text(html: Column) -> Column:
    """The text of an HTML document, nothing put where the markup was.

    Left out: tags, comments, declarations, processing instructions, and the
    text of script, style, template and ruby annotation elements. Known gaps
    against a tree-building parser: a tag whose attribute quote never closes is
    read up to the next ``>``, and templates inside templates end early. A comment
    that never closes stays as text, with the tags after it removed; a CDATA part
    that never closes stays with all that follows.
    """
    def rest_of(text: Column) -> Column:
        at = F.instr(text, "<!--")
        rest = F.regexp_replace(F.substring(text, at, 1 << 30), _MARKUP, _CUT + "$1")
        return F.when(at > 0, F.concat(F.left(text, at - 1), rest)).otherwise(text)

    unmarked = with_value(F.regexp_replace(html, _COMMENT_OR_MARKUP, _CUT + "$1$4"), rest_of)
    # Texts without markup are not read as a pattern's input at all.
    bare = F.when(F.contains(html, F.lit("<")), unmarked).otherwise(html)
    return F.replace(decode_entities(bare), F.lit(_CUT), F.lit(""))


def collapse_whitespace(text: Column) -> Column:
    """Every run of white space becomes one space; none at either end."""
    return F.btrim(F.regexp_replace(text, _UNEVEN_RUN, " "), F.lit(" "))


def clean_html(html: Column) -> Column:
    """HTML to one line of plain text; NULL stays NULL."""
    return collapse_whitespace(html_text(html))


def strip(text: Column) -> Column:
    """Trim all white space, not only spaces."""
    return F.btrim(text, F.lit(WHITESPACE))


def occurrences(text: Column, keyword: str | Column) -> Column:
    """How often ``keyword`` occurs in ``text``, literally and without overlap.

    Both sides are taken as given, so lower-case them first for a count that
    ignores case. An empty keyword occurs once before each character and once
    at the end. Lengths are compared in bytes, which Spark knows without a scan.
    """
    if isinstance(keyword, str):
        if keyword == "":
            return F.length(text).cast("long") + 1
        removed = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(keyword), F.lit("")))
        return (removed / len(keyword.encode())).cast("long")
    removed = F.octet_length(text) - F.octet_length(F.replace(text, keyword, F.lit("")))
    width = F.greatest(F.octet_length(keyword), F.lit(1))
    return F.when(keyword == "", F.length(text).cast("long") + 1).otherwise(
        (removed / width).cast("long"))


def matches(text: Column, pattern: str, literal: bool = False) -> Column:
    """Whether a regex is found in ``text``, ignoring case; NULL counts as no.

    The pattern is a Java regex with Unicode case folding. ``literal`` searches
    for the characters themselves.
    """
    if literal:
        pattern = "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.coalesce(F.rlike(text, F.lit("(?iu)" + pattern)), F.lit(False))


def preview(text: Column, width: int = 200) -> Column:
    """The first characters of a text followed by three dots."""
    return F.concat(F.substring(F.coalesce(text, F.lit("")), 1, width), F.lit("..."))


def first_filled(first: Column, *rest: Column) -> Column:
    """The first value that is neither NULL nor empty, else the last one."""
    *earlier, last = (first, *rest)
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in earlier], last)


def filled(text: Column) -> Column:
    """Whether a text is neither NULL nor empty."""
    return F.coalesce(text, F.lit("")) != ""


def split_list(text: Column, keep_empty: bool = False) -> Column:
    """A comma-separated text as an array of trimmed entries."""
    parts = F.transform(F.split(text, ","), strip)
    return parts if keep_empty else F.filter(parts, lambda x: x != "")


def join_list(values: Column, separator: str = ", ") -> Column:
    """An array of texts as one text; NULL and empty arrays give ''."""
    return F.coalesce(F.array_join(values, separator), F.lit(""))


def utf16_units(text: Column) -> Column:
    """Length of a text the way a national-character column counts it."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")
