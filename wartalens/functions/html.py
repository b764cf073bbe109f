"""Article text from page HTML and titles from URLs, as native expressions.

A page is read token by token, as a tolerant parser does: comments, declarations, scripts and styles
(which end with the page if nothing closes them), tags (whose quoted attributes may hold ``>``) and
text. Each token becomes a mark or a piece of text, so everything after works on one string.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from wartalens.functions.arrays import as_column, let

MIN_PARAGRAPH = 20            # paragraphs must be longer than this
# A paragraph ends at its own end tag or, as HTML5 has it, at any block tag.
BLOCKS = [
    "address", "article", "aside", "blockquote", "body", "center", "details", "dialog", "dd", "dir", "div",
    "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "pre", "section", "summary",
    "table", "td", "th", "tr", "ul",
]
INSIDE = """(?:[^"'>]+{p}|"[^"]*"|'[^']*'|["']){q}"""                 # between tag name and ``>``; a lone quote ends with the tag
TAG_NAME = r"[a-zA-Z][^\s/>]*"


def token_pattern(possessive: bool = True) -> str:
    """One token of a page; ``possessive`` repeats never step back (same tokens, bounded stack)."""
    inside = INSIDE.format(p="+" if possessive else "", q="*+" if possessive else "*")
    raw = "|".join(rf"<{name}(?:[\s/]{inside})?(?:>.*?(?:</{name}(?:[\s/][^>]*)?>|\z)|\z)" for name in ("script", "style"))
    return rf"(?is)<!--.*?(?:-->|\z)|<[!?][^>]*(?:>|\z)|{raw}|</?{TAG_NAME}{inside}(?:>|\z)|</[^a-zA-Z>][^>]*(?:>|\z)|</>|<|[^<]+"


IS_TAG = r"^(?:</?[a-zA-Z]|<[!?]|</)"
PARAGRAPH = r"(?i)^<p(?:[\s/>]|$)"
PARAGRAPH_END = r"(?i)^(?:</p(?:[\s/>]|$)|</?(?:" + "|".join(BLOCKS) + r")(?:[\s/>]|$))"
OPEN, CLOSE, APART = "\x01", "\x02", "\x03"
EDGES = " \t\n\r\f\x0b\xa0"

# Character references, from the standard table: with semicolon any name, without it the old names only.
NAMED = {name[:-1]: char for name, char in html5.items() if name.endswith(";")}
BARE = sorted((name for name in html5 if not name.endswith(";")), key=lambda name: (-len(name), name))
OLD_NAME = f"^({'|'.join(BARE)})"
REFERENCE = rf"^(#0*[0-9]{{1,7}};?|#[xX]0*[0-9a-fA-F]{{1,6}};?|[a-zA-Z][a-zA-Z0-9]*;|(?:{'|'.join(BARE)}))"
# Numbers of the old Windows set, as browsers read them.
WINDOWS = {byte: bytes([byte]).decode("cp1252") for byte in range(0x80, 0xA0) if byte not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
SLOTS = 2048


def _slot_of(name: str) -> int:
    return (len(name) * 131 + ord(name[0]) * 31 + ord(name[-1]) * 7 + ord(name[len(name) // 2])) % SLOTS


def _named(name: Column) -> Column:
    """Character of a reference name; null if there is none. One hashed bucket is searched."""
    buckets: list[list[dict]] = [[] for _ in range(SLOTS)]
    for known, char in NAMED.items():
        buckets[_slot_of(known)].append({"k": known, "v": char})
    table = F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<k:string,v:string>>>")
    at = lambda i: F.ascii(F.substring(name, i, F.lit(1)))
    size = F.length(name)
    slot = (size * 131 + at(F.lit(1)) * 31 + at(size) * 7 + at(F.floor(size / 2).cast("int") + 1)) % SLOTS
    return F.get(F.filter(F.get(table, slot), lambda e: e["k"] == name), F.lit(0))["v"]


def _numbered(value: Column) -> Column:
    """Character of a code point; surrogates become the replacement character, zero and too large numbers none."""
    windows = F.create_map(*[F.lit(x) for pair in WINDOWS.items() for x in pair])
    char = F.decode(F.unhex(F.lpad(F.hex(value), 8, "0")), "UTF-32")
    known = F.when(value.between(0xD800, 0xDFFF), "\ufffd").when(
        value.between(0x80, 0x9F), F.coalesce(F.try_element_at(windows, value.cast("int")), char)).otherwise(char)
    return F.when(value.between(1, 0x10FFFF), known)


def decode_entities(text: Column | str) -> Column:
    """HTML 5 character references; unknown ones stay.

    Without its semicolon, or at the front of a longer name, a name counts if it is one of the old names.
    """
    def replaced(piece: Column, found: Column) -> Column:
        name = F.regexp_replace(found, ";$", "")
        digits = F.regexp_replace(name, "^#[xX]?0*", "")             # none left: zero
        value = F.when(name.rlike("^#[xX]"), F.conv(digits, 16, 10).cast("long")).otherwise(digits.try_cast("long"))
        char = F.when(name.startswith("#"), _numbered(value)).when(name != "", _named(name))
        return F.concat(char, F.substring(piece, F.length(found) + 1, F.length(piece)))

    def one(piece: Column) -> Column:
        whole = let(F.regexp_extract(piece, REFERENCE, 1), lambda found: replaced(piece, found))
        front = let(F.regexp_extract(piece, OLD_NAME, 1), lambda found: replaced(piece, found))
        return F.coalesce(whole, front, F.concat(F.lit("&"), piece))

    def decoded(t: Column) -> Column:
        pieces = F.transform(F.split(t, "&"), lambda piece, i: F.when(i == 0, piece).otherwise(one(piece)))
        return F.when(t.contains("&"), F.array_join(pieces, "")).otherwise(t)

    return let(as_column(text), decoded)


def _marked(html: Column) -> Column:
    """The page as text with marks for paragraph starts, paragraph ends and other tags."""
    def mark(token: Column) -> Column:
        plain = F.translate(token, OPEN + CLOSE + APART, "")
        return (F.when(~token.rlike(IS_TAG), plain).when(token.rlike(PARAGRAPH), OPEN)
                .when(token.rlike(PARAGRAPH_END), CLOSE).otherwise(APART))

    return F.array_join(F.transform(F.regexp_extract_all(html, F.lit(token_pattern()), 0), mark), "")


def _visible(marked: Column) -> Column:
    """Text nodes between marks, decoded and trimmed, joined by one space."""
    nodes = F.transform(F.split(marked, f"[{OPEN}{CLOSE}{APART}]"), lambda node: F.trim(decode_entities(node), F.lit(EDGES)))
    return F.array_join(F.filter(nodes, lambda node: node != ""), " ")


def visible_text(fragment: Column | str) -> Column:
    """Text nodes of an HTML fragment, trimmed, joined by one space."""
    return let(_marked(as_column(fragment)), _visible)


def extract_article(html: Column | str) -> Column:
    """Paragraphs longer than 20 characters joined by newlines; without any, the whole text.

    A paragraph reaches to its end tag, the next paragraph, the next block tag or the end of the page.
    """
    def paragraphs(marked: Column) -> Column:
        pieces = F.split(marked, OPEN)
        texts = F.transform(
            F.slice(pieces, F.lit(2), F.size(pieces)), lambda piece: _visible(F.substring_index(piece, CLOSE, 1))
        )
        joined = F.array_join(F.filter(texts, lambda t: F.length(t) > MIN_PARAGRAPH), "\n")
        return let(joined, lambda text: F.when(text != "", text).otherwise(_visible(marked)))

    return let(_marked(as_column(html)), paragraphs)


def url_title(url: Column | str) -> Column:
    """Last path segment, dashes to spaces, every run of letters capitalised."""
    mark = "⁣"
    segment = F.lower(F.replace(F.element_at(F.split(as_column(url), "/"), -1), F.lit("-"), F.lit(" ")))
    spaced = F.regexp_replace(segment, r"(\p{L}+)", mark + " $1")
    return F.replace(F.initcap(spaced), F.lit(mark + " "), F.lit(""))
