"""URL verdicts from rules, and from trust and distrust that spread over the host link graph.

Rules ``(verdict, host, path)`` decide the urls they fit. Every other url gets the verdict of its host:
trust starts at hosts in proportion to their urls that rules allow and follows links forward; distrust
starts at hosts in proportion to their blocked urls and follows links **backwards**, to those that link
to them. Both are personalised PageRanks, written as the series ``sum over k of (damping * links)^k
seeds``, in units of one host whose urls are all allowed (blocked). Masses are whole numbers
(``SCALE`` a unit) and every share is rounded down, so sums do not depend on the order of rows.

The host graph is a table of ``(source host, target host, count)``, combined map-side from the pages:
a host with any share of the pages is a few rows. A round joins only the hosts whose mass still
moves with the edges and adds up by target; each round is written, so a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wartalens.llm.common import free_name, quoted
from wartalens.session import stage

SCALE = 1_000_000_000
DAMPING = 0.85
ROUNDS = 40                           # 0.85 ** 40: under two thousandths of the mass still to move
BLOCK_AT = 0.25                       # a blocked host shares its distrust among all that link to it
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Absolute or protocol-relative addresses in link and source attributes.
LINK = r"""(?i)(?:href|src)[\t\n\r ]*=[\t\n\r ]*["']?[\t\n\r ]*((?:[a-z][a-z0-9+.-]*:)?//[^"'<>\t\n\r ]*)"""

Rule = tuple[str, str, str]           # verdict, host, path


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    after = F.substring_index(url, "://", 1)
    rest = F.substring(url, F.length(after) + 4, F.length(url))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.when(F.contains(url, F.lit("://")), host).otherwise("")


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    after = F.substring_index(url, "://", 1)
    rest = F.substring(url, F.length(after) + 4, F.length(url))
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def _by_rules(host: Column, path: Column, rules: Sequence[Rule], answer) -> Column:
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):       # the longest is asked first
        own = (host == rule[1]) | F.endswith(host, F.lit("." + rule[1]))
        found = F.when(own & F.startswith(path, F.lit(rule[2])), answer(rule)).otherwise(found)
    return found


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Host and path of the longest rule that fits, joined; null if none does."""
    return _by_rules(host, path, rules, lambda r: F.lit(r[1] + r[2]))


def rule_verdict(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    return _by_rules(host, path, rules, lambda r: F.lit(r[0]))


def mentions(pages: DataFrame, rules: Sequence[Rule], url: str = "url", html: str = "html") -> DataFrame:
    """``(src, dst, said, n)``: urls of host ``dst`` seen on pages of ``src``, by the verdict of the rules.

    A page's own url counts once with ``src = dst``; a link to the same host says nothing and is left
    out; equal links of one page count once. Pages without host and links without host are left out.
    """
    links = F.array_distinct(F.regexp_extract_all(F.coalesce(quoted(html), F.lit("")), F.lit(LINK), 1))
    whole = F.transform(links, lambda x: F.when(F.startswith(x, F.lit("//")), F.concat(F.lit("http:"), x)).otherwise(x))
    own = F.coalesce(quoted(url), F.lit(""))
    seen = pages.select(url_host(own).alias("src"), F.explode(F.concat(
        F.array(F.struct(own.alias("url"), F.lit(True).alias("own"))),
        F.transform(whole, lambda x: F.struct(x.alias("url"), F.lit(False).alias("own"))),
    )).alias("m"))
    parted = seen.select("src", F.col("m.own").alias("own"), url_host(F.col("m.url")).alias("dst"), url_path(F.col("m.url")).alias("path"))
    known = parted.filter("src <> '' AND dst <> '' AND (own OR src <> dst)")
    said = rule_verdict(F.col("dst"), F.col("path"), rules).alias("said")
    return known.groupBy("src", "dst", said).agg(F.count("*").alias("n"))


def seeds(seen: DataFrame) -> DataFrame:
    """``(kind, host, mass)``: share of a host's urls that the rules allow (trust) or block (distrust)."""
    counted = seen.groupBy(F.col("dst").alias("host")).agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col("said") == v, F.col("n")).otherwise(0)).alias(v) for v in ("allow", "block")])
    mass = lambda v: F.floor(F.col(v) * F.lit(SCALE) / F.col("n"))
    both = F.array(F.struct(F.lit("trust").alias("kind"), mass("allow").alias("mass")),
                   F.struct(F.lit("distrust").alias("kind"), mass("block").alias("mass")))
    return counted.select("host", F.inline(both)).filter("mass > 0").select("kind", "host", "mass")


def flows(seen: DataFrame, damping: float = DAMPING) -> DataFrame:
    """``(kind, host, onto, share)``: the part of a host's mass that moves along each edge, damping included.

    Trust moves from the linking host to the linked one, distrust from the linked to the linking one.
    """
    edges = stage(seen.filter("src <> dst").groupBy("src", "dst").agg(F.sum("n").alias("n")), "edges")
    parts = []
    for kind, host, onto in (("trust", "src", "dst"), ("distrust", "dst", "src")):
        total = edges.groupBy(F.col(host).alias("host")).agg(F.sum("n").alias("total"))
        parts.append(edges.select(F.lit(kind).alias("kind"), F.col(host).alias("host"), F.col(onto).alias("onto"), "n")
                     .join(total, "host").select("kind", "host", "onto", (F.lit(damping) * F.col("n") / F.col("total")).alias("share")))
    return parts[0].unionByName(parts[1])


def spread_mass(start: DataFrame, along: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(host, trust, distrust)``: the masses of all rounds added up, for hosts that have any."""
    moved = [start]
    for _ in range(rounds):
        nearer = moved[-1].join(along, ["kind", "host"]).groupBy("kind", F.col("onto").alias("host")).agg(
            F.sum(F.floor(F.col("mass") * F.col("share"))).alias("mass")).filter("mass > 0")
        moved.append(stage(nearer, "moved"))
        if moved[-1].isEmpty():
            break
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("mass")).otherwise(0)).alias(kind)
    return reduce(DataFrame.unionByName, moved).groupBy("host").agg(of("trust"), of("distrust"))


def host_trust(pages: DataFrame, rules: Sequence[Rule], url: str = "url", html: str = "html",
               damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """``(host, trust, distrust)`` in ``SCALE``-ths, for hosts with any; an empty table of pages gives none."""
    seen = stage(mentions(pages, rules, url, html), "mentions")
    start = stage(seeds(seen), "seeds")
    return spread_mass(start, stage(flows(seen, damping), "flows"), rounds)


def judge(pages: DataFrame, rules: Sequence[Rule], url: str = "url", html: str = "html", damping: float = DAMPING,
          rounds: int = ROUNDS, block_at: float = BLOCK_AT) -> DataFrame:
    """All columns of ``pages`` with ``host, path, rule, verdict, trust, distrust``.

    A rule that fits decides, the longest first. Else a url is blocked if its host's distrust is at
    least ``block_at`` and greater than its trust, and allowed if not; so a tie, a host no seed reaches
    and a url without host are allowed. A null url is one without host, a null page has no links,
    repeated pages count as often as they stand there. Columns of these names are replaced.
    """
    scores = stage(host_trust(pages, rules, url, html, damping, rounds), "host-trust")
    at = free_name(pages.columns, "_host")
    kept = [quoted(c) for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "trust", "distrust")]
    known = F.coalesce(quoted(url), F.lit(""))
    placed = pages.select(*kept, url_host(known).alias("host"), url_path(known).alias("path"))
    joined = placed.join(scores.withColumnRenamed("host", at), F.col("host") == F.col(at), "left")
    trust, distrust = (F.coalesce(c, F.lit(0)) for c in ("trust", "distrust"))
    by_links = F.when((distrust >= int(block_at * SCALE)) & (distrust > trust), "block").otherwise("allow")
    return joined.select(
        *[quoted(c) for c in placed.columns],
        fitting_rule(F.col("host"), F.col("path"), rules).alias("rule"),
        F.coalesce(rule_verdict(F.col("host"), F.col("path"), rules), by_links).alias("verdict"),
        (trust / SCALE).alias("trust"), (distrust / SCALE).alias("distrust"),
    )
