"""Text cleaning as native Column expressions, one function per rule.

The order of the rules in :func:`base_clean` matters: prefixes are looked for at the
start of the lowercased text, and clock times before digits are dropped.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from wartalens.functions.arrays import as_column, let
from wartalens.functions.batches import arrow_column

# Patterns of the cleaning rules.
URL = r"https?://\S+|www\.\S+"
ENTITIES = ["&nbsp;", "&amp;", "&quot;", "&lt;", "&gt;", "&mdash;", "&ndash;"]
CLOCK = r"\b(?:pukul\s*)?\d{1,2}[:.\-]\d{2}\s*wib\b"
HTML_WORDS = ["nbsp", "br", "strong", "div", "span"]
NOT_LETTERS = r"[^a-zA-Z\s]"
SPACES = r"\s+"
WHITESPACE = " \t\n\r\f\x0b"

# Place names and portals that may open an article.
LEAD_PLACES = [
    "jakarta", "bandung", "surabaya", "medan", "semarang", "yogyakarta", "aceh",
    "bali", "papua", "maluku", "kalimantan", "sulawesi", "nusantara",
]
LEAD_PORTALS = [
    "kompas.com", "kompas", "cnn indonesia", "detikcom", "detik", "tribunnews.com", "tribunnews",
]

# Emoji blocks and single symbols (Unicode emoji data).
EMOJI = (
    r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2190}-\x{21AA}\x{23CF}-\x{23FF}\x{2B05}-\x{2B55}"
    r"\x{25AA}-\x{25FE}\x{E0020}-\x{E007F}\x{231A}\x{231B}\x{2328}\x{24C2}\x{2934}\x{2935}\x{3030}"
    r"\x{303D}\x{3297}\x{3299}\x{203C}\x{2049}\x{2139}\x{20E3}\x{200D}\x{FE0F}]"
)

# ASCII spellings of signs that have no Unicode decomposition of use.
SIGN_FOLDS = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th",
    "Þ": "Th", "…": "...", "€": "EUR", "£": "PS", "©": "(c)", "®": "(r)",
    "™": "tm", "°": "deg", "«": "<<", "»": ">>", "ﬁ": "fi", "ﬂ": "fl",
}
LETTER_FOLDS = {
    "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d",
    "Ð": "D", "ı": "i", "×": "x", "‘": "'", "’": "'", "‚": ",",
    "“": '"', "”": '"', "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-",
    "―": "-", "•": "*", "·": "*",
    "\u00a0": " ", "\u2009": " ", "\u200b": " ", "\u202f": " ", "\u3000": " ",
}
# Latin spellings of Cyrillic and Greek letters, in alphabetical order. The signs ъ and ь are apostrophes.
CYRILLIC = dict(zip(
    "абвгдеёжзийклмнопрстуфхцчшщъыьэюяєії",
    "a b v g d e io zh z i i k l m n o p r s t u f kh ts ch sh shch ' y ' e iu ia ie i yi".split(), strict=True))
GREEK = dict(zip(
    "αβγδεζηθικλμνξοπρσςτυφχψω", "a b g d e z e th i k l m n x o p r s s t u ph kh ps o".split(), strict=True))


def _script_folds() -> dict[str, str]:
    """Both cases of the letters above, and their accented forms that are one character."""
    small = CYRILLIC | GREEK
    folds = small | {c.upper(): s.capitalize() for c, s in small.items() if c != "ς"}
    for code in [*range(0x370, 0x530), *range(0x1F00, 0x2000)]:
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", char) if not unicodedata.combining(c))
        if char not in folds and base in folds:
            folds[char] = folds[base]
    return folds


SCRIPT_FOLDS = _script_folds()
LONG_FOLDS = {char: spelling for char, spelling in SCRIPT_FOLDS.items() if len(spelling) > 1}


def _single_folds() -> dict[str, str]:
    """Letters of one ASCII letter, and those whose Unicode decomposition is one ASCII character plus accents."""
    folds = LETTER_FOLDS | {char: spelling for char, spelling in SCRIPT_FOLDS.items() if len(spelling) == 1}
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00)]:
        char = chr(code)
        if char in folds or char in SIGN_FOLDS:
            continue
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base.isalnum():
            folds[char] = base
    return folds


SINGLE_FOLDS = _single_folds()
FOLD_FROM = "".join(SINGLE_FOLDS)
FOLD_TO = "".join(SINGLE_FOLDS.values())
LEAD_PATTERN = r"^\s*(?:" + "|".join(re.escape(w) for w in LEAD_PLACES + LEAD_PORTALS).replace(r"\ ", " ") + r")"
LEAD_TAIL = r"\s*[,–-]*\s*"
SCRIPTS = r"[\x{0370}-\x{052F}\x{1F00}-\x{1FFF}]"
COMBINING = r"[\x{0300}-\x{036F}]"
# What translating single characters leaves to do: signs, scripts with spellings of several letters, combining marks.
UNFOLDED = "[" + "".join(SIGN_FOLDS) + SCRIPTS[1:-1] + COMBINING[1:-1] + "]"

# The rules above as the row expressions run them: same matches, but a cheap look at the first character comes before
# groups, word boundaries and the long emoji class, which most characters of a text then never reach.
RUN_URL = r"(?i)(?=[hw])(?:https?://|www\.)\S+"
RUN_ENTITIES = r"(?i)&(?:" + "|".join(e[1:-1] for e in ENTITIES) + ");"
RUN_CLOCK = r"(?i)(?=[p\d])" + CLOCK
RUN_HTML_WORDS = r"(?i)(?=[" + "".join(sorted({w[0] for w in HTML_WORDS})) + r"])\b(?:" + "|".join(HTML_WORDS) + r")\b"
RUN_EMOJI = r"(?=[^\x00-\x{200C}])" + EMOJI
RUN_UNFOLDED = r"(?=[^\x00-\x7F])" + UNFOLDED
RUN_SCRIPTS = r"(?=[^\x00-\x{036F}])" + SCRIPTS
RUN_COMBINING = r"(?=[^\x00-\x{02FF}])" + COMBINING


def fold_unicode(text: Column | str) -> Column:
    """Zero-width space to space, Latin, Cyrillic and Greek letters and typographic signs to ASCII.

    Pure ASCII text skips the character tables, text without signs, Cyrillic, Greek and combining marks all but the
    first, text without Cyrillic and Greek the spellings of several letters. Other scripts, and Cyrillic letters outside :data:`CYRILLIC`, are kept here and dropped
    by :func:`keep_letters`.
    """
    def fold(column: Column) -> Column:
        translated = F.translate(column, FOLD_FROM, FOLD_TO)
        folded = translated
        for sign, ascii_form in SIGN_FOLDS.items():
            folded = F.replace(folded, F.lit(sign), F.lit(ascii_form))
        spelled = folded
        for char, spelling in LONG_FOLDS.items():
            spelled = F.replace(spelled, F.lit(char), F.lit(spelling))
        folded = F.when(column.rlike(RUN_SCRIPTS), spelled).otherwise(folded)
        folded = F.regexp_replace(folded, RUN_COMBINING, "")
        return (F.when(~column.rlike(r"[^\x00-\x7F]"), column)
                .when(column.rlike(RUN_UNFOLDED), folded).otherwise(translated))

    return let(as_column(text), fold)


def strip_urls(text: Column | str) -> Column:
    return F.regexp_replace(as_column(text), RUN_URL, " ")


def strip_emoji(text: Column | str, gap: str = " ") -> Column:
    """Emoji to a space; text without any character past Latin skips the search."""
    return let(
        as_column(text),
        lambda c: F.when(c.rlike(r"[^\x00-\x{024F}]"), F.regexp_replace(c, RUN_EMOJI, gap)).otherwise(c),
    )


def strip_entities(text: Column | str) -> Column:
    return F.regexp_replace(as_column(text), RUN_ENTITIES, " ")


def lower_trim(text: Column | str) -> Column:
    return F.trim(F.lower(as_column(text)), F.lit(WHITESPACE))


def strip_lead(text: Column | str, whole_word: bool = False) -> Column:
    """Drop one opening place or portal name and the commas or dashes behind it.

    The published rule has no word boundary ("balik" loses "bali"); ``whole_word``
    asks for one.
    """
    edge = r"\b" if whole_word else ""
    return F.regexp_replace(as_column(text), "(?i)" + LEAD_PATTERN + edge + LEAD_TAIL, "")


def strip_clock(text: Column | str) -> Column:
    return F.regexp_replace(as_column(text), RUN_CLOCK, " ")


def strip_html_words(text: Column | str) -> Column:
    return F.regexp_replace(as_column(text), RUN_HTML_WORDS, " ")


def keep_letters(text: Column | str) -> Column:
    return F.regexp_replace(as_column(text), NOT_LETTERS, " ")


def squeeze_spaces(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(as_column(text), SPACES, " "))


def fold_signs(text: Column | str, emoji_gap: str = " ") -> Column:
    """:func:`strip_emoji`, then :func:`fold_unicode`, in one look at the characters outside ASCII.

    Both replace single characters, so one table holds what becomes of each.
    """
    known = {ord(c): spelling for c, spelling in (SINGLE_FOLDS | SIGN_FOLDS | LONG_FOLDS).items()}
    emoji, combining = (re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", x) for x in (EMOJI, COMBINING))

    def prepare():
        is_emoji, is_mark, outside = re.compile(emoji), re.compile(combining), re.compile(r"[^\x00-\x7F]+")

        class Table(dict):
            def __missing__(self, code):
                char = chr(code)
                self[code] = emoji_gap if is_emoji.match(char) else known.get(code, "" if is_mark.match(char) else char)
                return self[code]

        table = Table()

        def fold(value):
            return value if value is None or value.isascii() else outside.sub(lambda m: m[0].translate(table), value)

        return lambda texts: pa.array([fold(value) for value in texts.to_pylist()], pa.string())

    return arrow_column(prepare, "string")(as_column(text))


def strip_noise(text: Column | str, emoji_gap: bool = True, whole_word_lead: bool = False) -> Column:
    """The rules of :func:`base_clean` in order, up to those that keep letters and single spaces."""
    cleaned = F.coalesce(as_column(text), F.lit(""))
    cleaned = strip_entities(strip_urls(fold_signs(cleaned, " " if emoji_gap else "")))
    cleaned = strip_lead(lower_trim(cleaned), whole_word_lead)
    return strip_html_words(strip_clock(cleaned))


def base_clean(text: Column | str, emoji_gap: bool = True, whole_word_lead: bool = False) -> Column:
    """All rules in order; null gives the empty string.

    With ``emoji_gap`` an emoji between two words separates them. Without it, emoji
    vanish while folding to ASCII, so the two words grow together.
    """
    # keep_letters and squeeze_spaces in one pass: any run without letters is one space
    return F.trim(F.regexp_replace(strip_noise(text, emoji_gap, whole_word_lead), "[^a-zA-Z]+", " "))
