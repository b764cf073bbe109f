"""Article text from broken pages; every expectation is worked out by hand."""

import html as standard
import random

import pytest
from pyspark.sql import functions as F

from wartalens.functions.html import BARE, NAMED, decode_entities, extract_article, visible_text

LONG = "A paragraph of more than twenty characters"
PAGES = {
    "plain": (f"<p>{LONG}</p>", LONG),
    "two": (f"<p>{LONG}</p><p>short</p><p>{LONG} two</p>", f"{LONG}\n{LONG} two"),
    "unclosed paragraphs": (f"<p>{LONG}<p>{LONG} two", f"{LONG}\n{LONG} two"),
    "block ends paragraph": (f"<p>{LONG}<div>not part of it at all, though long</div>", LONG),
    "inline tags inside": (f"<p>{LONG} <b>bold</b><i>x</i></p>", f"{LONG} bold x"),
    "unclosed script": (f"<p>{LONG}</p><script>var p = '<p>this is code, not an article</p>';", LONG),
    "unclosed style": (f"<p>{LONG}</p><style>p {{ content: '<p>this is a style and not text' }}", LONG),
    "script holding an end tag in a string": (f"<script>var t = \"</p><p>code that looks like text\";</script><p>{LONG}</p>", LONG),
    "script end with spaces": (f"<script>a</SCRIPT  ><p>{LONG}</p>", LONG),
    "unclosed comment": (f"<p>{LONG}</p><!-- <p>a comment that never ends and is long</p>", LONG),
    "comment holding a script": (f"<!-- <script> --><p>{LONG}</p><!-- </script> -->", LONG),
    "attribute holding >": (f"<p title=\"a > b\" data-x='>>'>{LONG}</p>", LONG),
    "attribute holding a tag": (f"<p><a title=\"<script>\">{LONG}</a></p>", LONG),
    "attribute holding a paragraph": (f"<img alt='<p>no paragraph at all, only a picture'><p>{LONG}</p>", LONG),
    "lone quote in a tag": (f"<p class=\">{LONG}</p>", LONG),
    "upper case and odd tags": (f"<P\n>{LONG}</P ><pre>preformatted text is no paragraph</pre><param><p/>{LONG} two", f"{LONG}\n{LONG} two"),
    "lone signs": (f"<p>1 < 2 and {LONG} & more > less</p>", f"1 < 2 and {LONG} & more > less"),
    "tag cut off at the end": (f"<p>{LONG}</p><a href=\"x", LONG),
    "references without semicolon": (f"<p>{LONG} &amp &copy2025 &notit; &eacutet&eacute</p>", f"{LONG} & ©2025 ¬it; été"),
    "HTML 5 names and numbers": (f"<p>{LONG} &rarr;&hellip;&NotEqualTilde;&#8217;&#x201C &#150;&#55296;&#0;&unknown;</p>", f"{LONG} →…≂̸’“ –�&#0;&unknown;"),
    "escaped tags stay text": (f"<p>{LONG} &lt;p&gt; &amp;lt;</p>", f"{LONG} <p> &lt;"),
    "no paragraph": ("<h1>Title</h1>some <b>text</b><!-- no --> here", "Title some text here"),
    "only short ones": ("<p>short</p><p>too</p> tail", "short too tail"),
    "declaration and instruction": (f"<!DOCTYPE html><?xml version='1'?><p>{LONG}</p>", LONG),
    "bogus end tags": (f"</><p>{LONG}</ b> end</p>", f"{LONG} end"),
    "list in an open paragraph": (f"<p>{LONG}<ul><li>an item that is no paragraph by itself</ul>", LONG),
    "marks in the text": (f"<p>{LONG}\x01\x02\x03</p>", LONG),
    "empty": ("", ""), "no tags": ("just text", "just text"),
}


def test_broken_pages(spark):
    rows = spark.createDataFrame([(name, page) for name, (page, _) in PAGES.items()], "name string, html string")
    got = {r["name"]: r["t"] for r in rows.select("name", extract_article("html").alias("t")).collect()}
    assert {n: (got[n], want) for n, (_, want) in PAGES.items() if got[n] != want} == {}
    assert spark.createDataFrame([(None,)], "html string").select(extract_article("html")).first()[0] is None


def test_references_as_the_standard_library_reads_them(spark):
    draw = random.Random(1)
    texts = [f"&{name}; x" for name in draw.sample(sorted(NAMED), 300)] + [f"&{name}!" for name in BARE] + [f"&{name} x" for name in BARE]
    texts += [f"&#{n};" for n in (65, 128, 150, 159, 160, 8364, 55296, 128512)] + ["&#x41", "&#X1F600;", "&", "&&amp;&", "&;", "&#;", "&#x;"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", decode_entities("t").alias("d")).collect()
    assert {r["t"]: (r["d"], standard.unescape(r["t"])) for r in rows if r["d"] != standard.unescape(r["t"])} == {}


@pytest.mark.parametrize("size", [200_000])
def test_very_long_pages(spark, size):
    page = "<p " + "a='b' " * size + ">" + "x" * 30 + "<script>" + "<" * size + "</script><i>" * 50 + "\"" * size
    rows = spark.createDataFrame([(page,)], "html string")
    assert rows.select(F.length(extract_article("html"))).first()[0] >= 30
    assert rows.select(visible_text("html")).first()[0].startswith("x" * 30)
