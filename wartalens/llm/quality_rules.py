"""Quality rules as a learned decision list. DataFrame functions only.

Text statistics are native expressions over one row. Learning is sequential covering on labelled
statistics: the labelled rows are counted per cell of a grid of quantile cuts (one aggregate), and
on that bounded table rules are grown condition by condition, each condition a threshold on
one statistic, then pruned on held-back counts. The list becomes one ``CASE WHEN`` column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wartalens.llm.common import let, quoted, words_of

SYMBOLS = "#*$%&|<>"
QUANTILES = [0.02, 0.5, 0.98]         # of the good and of the bad rows; thresholds lie halfway between neighbours
MAX_RULES = 12
MAX_CONDITIONS = 3
MIN_COVER = 20                        # labelled rows a rule must cover while growing
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "bang_share")


def repeat_words(words: Column) -> Column:
    """Words lying in a 3-word window that occurs twice or more in the text.

    Windows are compared by a 64-bit hash of their words. Most texts repeat none and end with one
    hash set; in the others the places of each window are sorted together.
    """
    def covered(h: Column) -> Column:
        pairs = F.zip_with(h, F.sequence(F.lit(0), F.size(h) - 1), lambda x, i: F.struct(x.alias("h"), i.alias("i")))

        def twice(s: Column) -> Column:
            hashes = s["h"]
            same = F.zip_with(
                s,
                F.zip_with(
                    F.concat(F.array(F.lit(None).cast("bigint")), F.slice(hashes, 1, F.size(s) - 1)),
                    F.concat(F.slice(hashes, 2, F.size(s) - 1), F.array(F.lit(None).cast("bigint"))),
                    lambda before, after: F.struct(before.alias("b"), after.alias("a")),
                ),
                lambda x, near: F.when((x["h"] == near["b"]) | (x["h"] == near["a"]), x["i"]),
            )
            places = F.sort_array(F.filter(same, lambda x: x.isNotNull()))
            return let(places, lambda p: F.aggregate(
                F.zip_with(p, F.slice(p, 2, F.size(p)), lambda here, following: F.least(
                    F.lit(3), F.coalesce(following - here, F.lit(3)))),
                F.lit(0), lambda total, x: total + x))

        return let(F.sort_array(pairs), twice)

    def counted(w: Column) -> Column:
        n = F.size(w) - 2
        hashes = F.zip_with(
            F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.xxhash64(a, b)),
            F.slice(w, 3, n), lambda ab, c: F.xxhash64(ab, c),
        )
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))

    return let(words, lambda w: F.when(F.size(w) < 3, F.lit(0)).otherwise(counted(w))).cast("long")


def base_statistics(text: Column) -> dict[str, Column]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a text; zeros for null."""
    content = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(content, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words_of(text)).cast("long"),
        "word_chars": F.length(F.regexp_replace(content, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": (F.length(content) - F.length(F.translate(content, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(words_of(text)),
        "n_bangs": (F.length(content) - F.length(F.translate(content, "!?", ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
    }


def with_statistics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and the statistics of each row, and the ratios rules are made of."""
    counts = docs.select(
        quoted(key).alias("doc_id"),
        *[c.alias(n) for n, c in base_statistics(quoted(text).cast("string")).items()])
    share = lambda part, whole: F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))
    return counts.select(
        "*",
        share("word_chars", "n_words").alias("mean_word"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_bangs", "word_chars").alias("bang_share"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool                       # feature > threshold, else feature <= threshold
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class Rule:
    """Rows that meet all conditions are bad."""

    conditions: tuple[Condition, ...]
    bad: int
    good: int


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered expression: true where no rule calls the row bad."""
    column = None
    for rule in rules:
        test = rule.conditions[0].column()
        for condition in rule.conditions[1:]:
            test = test & condition.column()
        column = F.when(test, F.lit(False)) if column is None else column.when(test, F.lit(False))
    return F.lit(True) if column is None else column.otherwise(F.lit(True))


def labelled_cells(rows: DataFrame, label: str, cuts: dict[str, list[float]], features=FEATURES) -> list[tuple]:
    """Counts per grid cell: ``(cell, grow bad, grow good, prune bad, prune good)``.

    At most ``(2 * len(QUANTILES)) ** features`` cells, whatever the number of rows.
    """
    cell = [
        sum(((F.col(f) > c).cast("int") for c in cuts[f]), F.lit(0)).alias(f"c{i}") for i, f in enumerate(features)
    ]
    grow = F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0
    bad = F.col(label) == 0
    counted = rows.select(*cell, grow.alias("grow"), bad.alias("bad")).groupBy(
        *[f"c{i}" for i in range(len(features))]
    ).agg(
        F.count_if(F.expr("grow and bad")).alias("gb"), F.count_if(F.expr("grow and not bad")).alias("gg"),
        F.count_if(F.expr("not grow and bad")).alias("pb"), F.count_if(F.expr("not grow and not bad")).alias("pg"),
    )
    return [(tuple(r[i] for i in range(len(features))), r["gb"], r["gg"], r["pb"], r["pg"]) for r in counted.collect()]


def _gain(bad: int, good: int, bad0: int, good0: int) -> float:
    """Information gained about a covered bad row, times the bad rows covered."""
    if not bad:
        return -math.inf
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad0 / (bad0 + good0)))


def cover(cells: list[tuple], cuts: dict[str, list[float]], features=FEATURES) -> list[Rule]:
    """Sequential covering: grow on the growing counts, prune on the others, remove what is covered."""
    rules: list[Rule] = []
    tests = [(i, above, k) for i, f in enumerate(features) for k in range(len(cuts[f])) for above in (True, False)]
    holds = lambda cell, t: (cell[t[0]] > t[2]) == t[1]
    rest = list(cells)
    while len(rules) < MAX_RULES and sum(c[1] for c in rest) >= MIN_COVER:
        chosen: list[tuple] = []
        inside = rest
        while len(chosen) < MAX_CONDITIONS and sum(c[2] for c in inside):
            bad0, good0 = sum(c[1] for c in inside), sum(c[2] for c in inside)
            best, best_gain = None, 1e-9
            for t in tests:
                bad = sum(c[1] for c in inside if holds(c[0], t))
                good = sum(c[2] for c in inside if holds(c[0], t))
                if bad + good >= MIN_COVER and (g := _gain(bad, good, bad0, good0)) > best_gain:
                    best, best_gain = t, g
            if best is None:
                break
            chosen.append(best)
            inside = [c for c in inside if holds(c[0], best)]

        def worth(tests_: list[tuple]) -> float:
            own = [c for c in rest if all(holds(c[0], t) for t in tests_)]
            bad, good = sum(c[3] for c in own), sum(c[4] for c in own)
            return (bad - good) / (bad + good) if bad + good else -1.0

        while len(chosen) > 1 and worth(chosen[:-1]) >= worth(chosen):
            chosen.pop()
        if not chosen or worth(chosen) <= 0.5:
            break
        own = [c for c in rest if all(holds(c[0], t) for t in chosen)]
        rules.append(Rule(
            tuple(Condition(features[i], above, cuts[features[i]][k]) for i, above, k in chosen),
            sum(c[1] + c[3] for c in own), sum(c[2] + c[4] for c in own),
        ))
        rest = [c for c in rest if not all(holds(c[0], t) for t in chosen)]
    return rules


def learn(rows: DataFrame, label: str = "quality", features=FEATURES) -> list[Rule]:
    """Rules from rows with statistics and a label (0 bad, 1 good; null is left out).

    Thresholds lie halfway between neighbouring quantiles of the good and of the bad rows. Without
    labelled rows there are no rules. Two aggregates.
    """
    known = rows.filter(F.col(label).isNotNull())
    found = known.agg(*[
        F.percentile_approx(F.when((F.col(label) == 0) == bad, F.col(f).cast("double")), QUANTILES, 10_000).alias(f"{f}_{bad}")
        for f in features for bad in (True, False)
    ]).first()
    cuts = {}
    for f in features:
        values = sorted({*(found[f"{f}_True"] or ()), *(found[f"{f}_False"] or ())})
        cuts[f] = [(a + b) / 2 for a, b in zip(values, values[1:])]
    return cover(labelled_cells(known, label, cuts, features), cuts, features)


def quality_rules(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
                  label_key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` of every document.

    Rules are learned from documents that pass the base rule and have a label; documents with a
    null key have none. A document labelled more than once takes its lowest label. ``kept`` is false
    where the base rule fails, else the verdict of the list. No rows or labels: no rules.
    """
    from wartalens.session import stage

    rows = stage(with_statistics(docs, text, key), "quality-statistics")
    marks = labels.groupBy(quoted(label_key).alias("_key")).agg(F.min(quoted(label)).alias("_label"))
    known = rows.join(marks, rows["doc_id"] == marks["_key"]).drop("_key").filter(~base_failed())
    rules = learn(known, "_label")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"),
    )
