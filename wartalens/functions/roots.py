"""Root candidates of Indonesian words by published confix stripping (Nazief and Adriani; Asian 2007).

A stemmer with a root-word list takes affixes off step by step and stops at the first form the list
knows. Here all forms are built at once, in the order in which the published algorithm looks
them up, so that a join with the list and the least position give the same stem: first the word, then
the word without particle, possessive and derivational suffix; then, from the shortest of these back to
the whole word, up to three prefixes are taken off each, with the letters that a prefix may
have swallowed put back. Prefixes and suffixes that never occur together are not taken off together.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wartalens.functions.arrays import as_column, let

PARTICLE = "(?:kah|lah|tah|pun)$"
POSSESSIVE = "(?:ku|mu|nya)$"
DERIVED = "(?:kan|an|i)$"
# Prefixes a word may not have if the given derivational suffix was taken off (but ke-tahu-i may).
FORBIDDEN = [("i", "^(?:be|se|ke(?:[^t]|t[^a]|ta[^h]|tah[^u]|tahu[^i]))"), ("an", "^(?:di|me|te)"), ("kan", "^(?:ke|se)")]
SHORTEST = 3                          # shorter words have no affixes, shorter forms are no roots
DEPTH = 3

# The published prefix rules. The first pattern that fits gives the candidates, in order.
V, C = "[aiueo]", "[bcdfghjklmnpqrstvwxyz]"
PREFIXES: list[tuple[str, list[str]]] = [
    (r"^(?:di|ke|se)(.+)$", ["$1"]),
    (r"^bel(ajar.*)$", ["$1"]),
    (rf"^ber({V}.*)$", ["$1", "r$1"]),
    (rf"^ber({C}.+)$", ["$1"]),
    (rf"^be([bcdfghjkmnpqstvwxyz]er{C}.+)$", ["$1"]),
    (rf"^ter({V}.*)$", ["$1", "r$1"]),
    (rf"^ter({C}.+)$", ["$1"]),
    (rf"^te([bcdfghjklmnpqstvwxyz]er{C}.+)$", ["$1"]),
    (rf"^me([lrwy]{V}.*)$", ["$1"]),
    (r"^mem([bfv].+)$", ["$1"]),
    (r"^mem(pe.+)$", ["$1"]),
    (rf"^mem(r?{V}.*)$", ["m$1", "p$1"]),
    (r"^mem(p.+)$", ["$1"]),
    (r"^men([cdjsz].+)$", ["$1"]),
    (rf"^meny({V}.*)$", ["s$1", "ny$1"]),
    (rf"^meng({V}.*)$", ["$1", "k$1", "ng$1"]),
    (r"^meng([ghqk].+)$", ["$1"]),
    (rf"^men({V}.*)$", ["n$1", "t$1"]),
    (r"^pel(ajar.*)$", ["$1"]),
    (rf"^pe([wyl]{V}.*)$", ["$1"]),
    (rf"^per({V}.*)$", ["$1", "r$1"]),
    (rf"^per({C}.+)$", ["$1"]),
    (r"^pem([bfv].+)$", ["$1"]),
    (rf"^pem(r?{V}.*)$", ["m$1", "p$1"]),
    (r"^pen([cdjsz].+)$", ["$1"]),
    (rf"^peny({V}.*)$", ["s$1", "ny$1"]),
    (rf"^peng({V}.*)$", ["$1", "k$1", "ng$1"]),
    (r"^peng([ghqk].+)$", ["$1"]),
    (rf"^pen({V}.*)$", ["n$1", "t$1"]),
    (r"^pe([bcdfghjkpqstvxz].+)$", ["$1"]),
]
NONE = "array<string>"


def _unprefixed(word: Column) -> Column:
    """Forms with one prefix less, in order; none if no rule fits or too little would be left."""
    found = F.array().cast(NONE)
    for pattern, forms in reversed(PREFIXES):
        found = F.when(word.rlike(pattern), F.array(*[F.regexp_replace(word, pattern, form) for form in forms])).otherwise(found)
    return F.filter(found, lambda form: F.length(form) >= SHORTEST)


def _with_prefixes_off(word: Column) -> Column:
    """Forms after one, two and three prefixes; a prefix is not taken off twice in a row."""
    def deeper(forms: Column) -> Column:
        one_less = lambda form: F.filter(_unprefixed(form), lambda x: F.substring(x, 1, 2) != F.substring(form, 1, 2))
        return F.flatten(F.transform(forms, one_less))

    def collected(forms: Column, depth: int) -> Column:
        if depth == DEPTH:
            return forms
        return F.concat(forms, let(deeper(forms), lambda more: collected(more, depth + 1)))

    return let(_unprefixed(word), lambda forms: collected(forms, 1))


def _suffix_off(word: Column, pattern: str) -> Column:
    shorter = F.regexp_replace(word, pattern, "")
    return F.when(F.length(shorter) >= SHORTEST, shorter).otherwise(word)


def root_candidates(token: Column | str) -> Column:
    """Forms of one lowercase token in the order of the published look-ups, without repeats; null for a null token."""
    def build(word: Column) -> Column:
        return let(_suffix_off(word, PARTICLE), lambda bare: let(_suffix_off(bare, POSSESSIVE), lambda own: let(
            _suffix_off(own, DERIVED), lambda core: candidates(word, bare, own, core))))

    def candidates(word: Column, bare: Column, own: Column, core: Column) -> Column:
        suffix = F.substring(own, F.length(core) + 1, F.length(own))
        forbidden = F.lit(False)
        for ending, prefix in FORBIDDEN:
            forbidden = forbidden | ((suffix == ending) & word.rlike(prefix))
        none = F.array().cast(NONE)
        # what ends in "-kan" may end in "-an" after a k
        ends_in_an = (suffix == "kan") & ~word.rlike(dict(FORBIDDEN)["an"])
        kept = F.concat(F.when(forbidden, none).otherwise(F.array(core)),
                        F.when(ends_in_an, F.array(F.concat(core, F.lit("k")))).otherwise(none))
        bases = F.array_distinct(F.concat(kept, F.array(own, bare, word)))
        first = F.concat(F.array(word, bare, own), kept)
        return F.array_distinct(F.concat(first, F.flatten(F.transform(bases, _with_prefixes_off))))

    return let(as_column(token), lambda word: F.when(F.length(word) <= SHORTEST, F.array(word)).otherwise(build(word)))
