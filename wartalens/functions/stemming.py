"""Dictionary-free Indonesian stemming: the affix rules published by Tala (2003).

Each rule is one ``regexp_replace``; a digit at the front of the intermediate form
remembers which prefix class was taken off, because that decides which suffixes may
follow. A rule fires only if two syllables (vowels) remain. The rules use no
lookaround, so any SQL engine with regular expressions gives the same stems.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wartalens.functions.arrays import as_column, let

_V = "[aiueo]"
_C = "[^aiueo]*"
_REST = f"{_C}{_V}{_C}{_V}.*"                     # two syllables, then anything
_BODY = f"{_C}{_V}{_C}{_V}[a-z]*?"                # two syllables, as short as possible
_BODY_NOT_S = f"{_C}{_V}{_C}(?:{_V}|{_V}[a-z]*?[^s])"

# Prefix classes: 1 ke-, 2 peng- group, 3 meng- group, di-, ter-, 4 ber-, 5 per-.
# 6 marks "first-order prefix and a suffix are gone".
RULES: list[tuple[str, str]] = [
    (f"^({_BODY})(?:kah|lah|pun)$", r"\1"),       # particles
    (f"^({_BODY})(?:ku|mu|nya)$", r"\1"),         # possessive pronouns
    (f"^meny({_V}{_C}{_V}.*)$", r"3s\1"),         # first-order prefixes
    (f"^peny({_V}{_C}{_V}.*)$", r"2s\1"),
    (f"^mem({_V}{_C}{_V}.*)$", r"3p\1"),
    (f"^pem({_V}{_C}{_V}.*)$", r"2p\1"),
    (f"^(?:meng|men|mem|me|di|ter)({_REST})$", r"3\1"),
    (f"^(?:peng|pen|pem)({_REST})$", r"2\1"),
    (f"^ke({_REST})$", r"1\1"),
    (r"^bel(ajar.*)$", r"4\1"),                   # second-order prefixes
    (f"^ber({_REST})$", r"4\1"),
    (f"^be([^aiueo]er{_C}{_V}.*)$", r"4\1"),
    (r"^pel(ajar.*)$", r"5\1"),
    (f"^(?:per|pe)({_REST})$", r"5\1"),
    (f"^3(?:({_BODY})kan|({_BODY_NOT_S})i)$", r"6\1\2"),          # suffixes
    (f"^[12]({_BODY})an$", r"6\1"),
    (f"^5?(?:({_BODY})(?:kan|an)|({_BODY_NOT_S})i)$", r"\1\2"),
    (f"^4({_BODY})(?:kan|an)$", r"\1"),
    (r"^6(?:bel|pel)(ajar.*)$", r"\1"),           # second-order prefix after a suffix
    (f"^6(?:ber|per|pe)({_REST})$", r"\1"),
    (r"^[1-6]", ""),
]
MIN_SYLLABLES = f"{_V}{_C}{_V}{_C}{_V}"           # fewer vowels: no rule can fire
AFFIXES = r"^(?:[1-6]|[mpbk]e|di|ter)|(?:[kl]ah|pun|[km]u|nya|an|i)$"     # what the first rule to fire needs


def stem_word(token: Column | str) -> Column:
    """Stem of one lowercase token; a token without any affix of the rules skips all of them."""
    def chain(t: Column) -> Column:
        for pattern, replacement in RULES:
            t = F.regexp_replace(t, pattern, replacement.replace("\\", "$"))
        return t

    return let(as_column(token), lambda t: F.when(t.rlike(AFFIXES) & t.rlike(MIN_SYLLABLES), chain(t)).otherwise(t))
