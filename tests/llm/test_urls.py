"""Url verdicts (11): rules, link graph against a plain loop, awkward pages, SQL on planted links."""

import os
import random
import re
from math import floor

import duckdb
import pytest

from wartalens.llm import link_trust, queries
from wartalens.llm.link_trust import SCALE

RULES = queries.URL_RULES
SCHEMA = "page_id bigint, url string, html string, Host string, trust string"


def parts(url):
    if "://" not in (url or ""):
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def by_rule(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def brute(rows, rounds):
    """Verdict, trust and distrust of every page, one host and edge at a time."""
    said, edges = {}, {}
    for _, url, html in rows:
        host, path = parts(url)
        if not host:
            continue
        found = dict.fromkeys(re.findall(link_trust.LINK, html or ""))
        for link in [url, *(("http:" + x if x.startswith("//") else x) for x in found)]:
            to, at = parts(link)
            if to and (link is url or to != host):
                said.setdefault(to, []).append(by_rule(to, at)[1])
                if to != host:
                    edges[host, to] = edges.get((host, to), 0) + 1
    total = {}
    for kind, verdict, way in (("trust", "allow", 0), ("distrust", "block", 1)):
        weight = {}
        for pair, n in edges.items():
            weight[pair[way]] = weight.get(pair[way], 0) + n
        mass = {h: m for h, v in said.items() if (m := floor(v.count(verdict) * SCALE / len(v)))}
        total[kind] = dict(mass)
        for _ in range(rounds):
            moved = {}
            for pair, n in edges.items():
                if pair[way] in mass:
                    part = floor(mass[pair[way]] * (link_trust.DAMPING * n / weight[pair[way]]))
                    moved[pair[1 - way]] = moved.get(pair[1 - way], 0) + part
            mass = {h: m for h, m in moved.items() if m}
            for h, m in mass.items():
                total[kind][h] = total[kind].get(h, 0) + m
    out = []
    for page, url, _ in rows:
        host, path = parts(url)
        rule, verdict = by_rule(host, path)
        t, d = (total[k].get(host, 0) for k in ("trust", "distrust"))
        if verdict is None:
            verdict = "block" if d >= link_trust.BLOCK_AT * SCALE and d > t else "allow"
        out.append((page, host, path, rule, verdict, t / SCALE, d / SCALE))
    return sorted(map(repr, out))


def linked_pages(seed=5, n=120):
    """Pages of a few hosts that link to each other, one host with a third of all pages."""
    draw = random.Random(seed)
    hosts = ["big.org", "a.example.com", "b.example.net", "c.net", "d.org", "www.example.com", "x.www.example.com", "e.org", "f.org:80"]
    rows = []
    for i in range(n):
        host = "big.org" if i % 3 == 0 else draw.choice(hosts)
        url = f"{draw.choice(['http', 'https'])}://{host.upper() if i % 7 == 0 else host}/{draw.choice(['en', 'es', 'fr'])}/{i}?q=/en/#x"
        links = [f'<a href="https://{draw.choice(hosts)}/{draw.choice(["en", "es"])}/{draw.randrange(4)}">' for _ in range(draw.randrange(5))]
        links += ["<a href='//e.org/en/1'>", '<img SRC = "http://d.org">', '<a href="/local">', "<a href=mailto:x@y.org>", links[0] if links else ""]
        rows.append((i, url, "".join(links)))
    return rows


def got(frame):
    columns = ["page_id", "host", "path", "rule", "verdict", "trust", "distrust"]
    return sorted(repr(tuple(row[c] for c in columns)) for row in frame.collect())


AWKWARD = [
    (1, None, "<a href='http://c.net/es/'>"), (2, "", None), (3, "no scheme", ""), (4, "http://", None), (5, "x://://", "<a href=//>"),
    (6, "http://COM", None), (7, "http://com/a", None), (7, "http://com/a", None), (None, None, None), (8, "http://xcom/a", None),
    (9, "http://é.com/ü?x", "<a href=\"http://c.net/es/1\">" * 5000), (10, "http://example.com/en", None), (11, "http://example.com/en/?a", None),
    (12, "http://a.com#/en/", None), (13, "http://user@b.net:8/es/", None), (14, "ftp://n.net/fr/\nx", "x" * 300_000),
]


@pytest.mark.parametrize("rows", [linked_pages(), linked_pages(9, 40), AWKWARD, AWKWARD + linked_pages(2, 30), []])
def test_against_plain_loop(spark, rows):
    pages = spark.createDataFrame([(*r, "h", "t") for r in rows], SCHEMA)
    assert got(link_trust.judge(pages, RULES, rounds=5)) == brute(rows, 5)


def test_links_move_verdicts(spark):
    """A host that links to blocked urls is blocked, one that a trusted host links to as well is not."""
    rows = [(1, "http://c.net/es/1", None), (2, "http://bad.org/1", "<a href='http://c.net/es/2'>"), (3, "http://good.org/1", "<a href='http://c.net/fr/2'>"),
            *[(4 + i, f"http://a.com/{i}", "<a href='http://good.org/x'>") for i in range(3)], (9, "http://alone.org/", None)]
    pages = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    verdicts = {row.page_id: row.verdict for row in link_trust.judge(pages, RULES, rounds=5).collect()}
    assert verdicts == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 9: "allow"}


def test_sql_says_the_same_on_links(spark, tmp_path):
    rows = linked_pages(11, 90) + AWKWARD
    pages = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA).select("page_id", "url", "html")
    pages.write.parquet(os.path.join(tmp_path, "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    frame = queries.QUERIES["op11_link_trust"](spark, str(tmp_path))
    cursor = con.execute(queries.ORACLES["op11_link_trust"])
    names = [d[0] for d in cursor.description]
    assert names == frame.columns
    assert sorted(map(repr, cursor.fetchall())) == got(frame)
