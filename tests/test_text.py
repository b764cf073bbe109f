import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from wartalens.functions import batches, stemming, text
from wartalens.functions.arrays import run_lengths
from wartalens.functions.html import decode_entities, extract_article, url_title
from wartalens.functions.stemming import stem_word
from wartalens.functions.tokens import preprocess_text, remove_stopwords, stem_tokens, tokenize


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, cleaned", [
    ("JAKARTA, KOMPAS.com – Presiden mengumumkan kebijakan baru. Pukul 21.30 WIB.",
     "kompas com presiden mengumumkan kebijakan baru"),
    ("detikcom - Rapat pukul 10-05 wib &nbsp;<br>selesai", "rapat selesai"),
    ("Balik nama kendaraan 2025", "k nama kendaraan"),
    ("Lihat https://a.b/c?d=1 rata-rata Rp5.000", "lihat rata rata rp"),
    ("Café Groß", "cafe gross"),
    ("Rapat 9:5 WIB", "rapat wib"),
    ("rapat​kerja besok", "rapat kerja besok"),
    ("hari😀ini", "hari ini"),
    (None, ""),
])
def test_base_clean(spark, raw, cleaned):
    assert one(spark, text.base_clean(F.lit(raw).cast("string"))) == cleaned


@pytest.mark.parametrize("raw, folded", [
    ("Москва", "Moskva"), ("Щука, Ёж и Юля", "Shchuka, Iozh i Iulia"), ("объявь", "ob'iav'"), ("Київ", "Kiyiv"), ("Ѝ й", "I i"),
    ("Αθήνα", "Athena"), ("ψυχή Φως", "psukhe Phos"), ("ἄνθρωπος", "anthropos"), ("й й", "i i"), ("中文 أب Ж", "中文 أب Zh"),
])
def test_other_scripts(spark, raw, folded):
    assert one(spark, text.fold_unicode(F.lit(raw))) == folded


def test_clean_options(spark):
    assert one(spark, text.base_clean(F.lit("hari😀ini"), emoji_gap=False)) == "hariini"
    assert one(spark, text.base_clean(F.lit("Balik nama"), whole_word_lead=True)) == "balik nama"
    assert one(spark, text.base_clean(F.lit("Bali - nama"), whole_word_lead=True)) == "nama"


def test_fused_pass_equals_two_rules(spark):
    samples = ["a1b  c\t2", "  x--y ", "\x0b9", "äö ß", ""]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    two = text.squeeze_spaces(text.keep_letters("s"))
    fused = F.trim(F.regexp_replace("s", "[^a-zA-Z]+", " "))
    assert df.filter(two != fused).count() == 0


def test_tokenize(spark):
    assert one(spark, tokenize(F.lit("k nama kendaraan"))) == ["nama", "kendaraan"]
    assert one(spark, tokenize(F.lit(""))) == []


@pytest.mark.parametrize("word, stem", [
    ("mengumumkan", "umum"), ("kebijakan", "bijak"), ("perekonomian", "ekonomi"), ("belajar", "ajar"),
    ("menyapu", "sapu"), ("memukul", "pukul"), ("kesehatan", "sehat"), ("bukunya", "buku"),
    ("ambilkanlah", "ambil"), ("diberikan", "beri"), ("keberhasilan", "hasil"), ("tas", "tas"), ("basi", "basi"),
])
def test_stem(spark, word, stem):
    assert one(spark, stem_word(F.lit(word))) == stem


def test_words_without_affix_skip_the_rules_with_the_same_stems(spark):
    fronts = ["", "1", "di", "ter", "me", "meny", "mem", "meng", "pe", "peny", "peng", "pel", "ke", "be", "bel", "ber", "bekera", "ba", "s"]
    ends = ["", "kah", "lah", "pun", "ku", "mu", "nya", "kan", "an", "i", "s", "a", "kan\n"]
    words = [a + middle + z for a in fronts for middle in ("ajar", "salo", "aneka", "x") for z in ends]
    plain = F.col("w")
    for pattern, replacement in stemming.RULES:
        plain = F.regexp_replace(plain, pattern, replacement.replace("\\", "$"))
    by_rules = F.when(F.col("w").rlike(stemming.MIN_SYLLABLES), plain).otherwise(F.col("w"))
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(
        "w", stem_word("w").alias("stem"), by_rules.alias("ruled"), F.col("w").rlike(stemming.AFFIXES).alias("tried")).collect()
    assert all(r["stem"] == r["ruled"] for r in rows)
    assert any(r["stem"] != r["w"] for r in rows) and {r["w"] for r in rows if not r["tried"]} >= {"aneka", "basalos"}


def test_stem_options(spark):
    tokens = F.array(F.lit("pemerintah"), F.lit("makanan"), F.lit("diberikan"))
    assert one(spark, stem_tokens(tokens, protected=["pemerintah"], overrides={"makanan": "santap"})) == [
        "pemerintah", "santap", "beri"]


def test_stopwords_again_after_stemming(spark):
    column = preprocess_text(F.lit("Katanya pasar dan pasarnya"), ["dan", "kata"])
    assert one(spark, column) == ["pasar", "pasar"]


def test_long_junk_token_is_linear(spark):
    assert len(one(spark, F.array_join(stem_tokens(F.array(F.lit("abcd" * 20000))), ""))) == 80000


def test_html(spark):
    page = (
        "<html><head><title>Judul</title><style>p{}</style><script>var a='</p><p>tidak';</script></head><body>"
        "<p class='x'>Paragraf <b>pertama</b> yang cukup panjang &amp; jelas.</p><p>pendek</p><pre>bukan paragraf</pre>"
        "<p>Paragraf kedua tanpa penutup<p>Paragraf ketiga &#8211; &#x41;&unknown; juga panjang<div>bukan isi</div></body></html>"
    )
    assert one(spark, extract_article(F.lit(page))) == (
        "Paragraf pertama yang cukup panjang & jelas.\nParagraf kedua tanpa penutup\n"
        "Paragraf ketiga – A&unknown; juga panjang"
    )
    assert one(spark, extract_article(F.lit("<title>A</title><p>kecil</p> x"))) == "A kecil x"
    assert one(spark, decode_entities(F.lit("&amp;lt; &quot;&#0;"))) == '&lt; "&#0;'
    assert one(spark, decode_entities(F.lit("&#00000233;&#x00000000e9;&#000000000000;&#99999999;"))) == "éé&#000000000000;&#99999999;"


def test_url_title(spark):
    assert one(spark, url_title(F.lit("https://x.id/a/harga-bbm-naik2x?p=1"))) == "Harga Bbm Naik2X?P=1"


def test_run_patterns_match_as_the_plain_rules(spark):
    """The row expressions' patterns replace what the published ones do, at word edges and in mixed case too."""
    pieces = ["&NBSP;", "&amp;", "&&lt;", "&gt", "&mdash;x", "br", "abr", "BR.", "strong-", "_div", "spań", "́nbsp", "HTTPS://a.b/c",
              "http:/x", "hwww.x", "WWW.", "www. z", "http://", "Pukul 21.30 WIB", "pukul9:05wib", "109:30 wib", "p10-05 WIBx", "pukulpukul 1.22 wib",
              "‼", "‍", "​", "\U0001f600", "ℹx", "é\U000e0041", "Ⓜ", "–"]
    texts = [f"{a}{gap}{b}" for a in pieces for b in pieces for gap in ("", " ")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = lambda pattern: F.regexp_replace("t", pattern, "_")
    pairs = [
        (text.RUN_URL, "(?i)" + text.URL), (text.RUN_ENTITIES, "(?i)" + "|".join(text.ENTITIES)), (text.RUN_CLOCK, "(?i)" + text.CLOCK),
        (text.RUN_HTML_WORDS, r"(?i)\b(?:" + "|".join(text.HTML_WORDS) + r")\b"), (text.RUN_EMOJI, text.EMOJI)]
    for run, published in pairs:
        rows = df.select("t", plain(run).alias("run"), plain(published).alias("published")).collect()
        assert [r["t"] for r in rows if r["run"] != r["published"]] == []
        assert any(r["t"] != r["run"] for r in rows)


def test_texts_without_signs_skip_their_replacements(spark):
    """Folding is the same for every sign, script and mark, alone and beside letters that are only translated."""
    signs = [*text.SIGN_FOLDS, *list(text.LONG_FOLDS)[:20], "ж", "λ", "é", "҃", "é", "–", "中", "a"]
    df = spark.createDataFrame([(f"{a}é{b}",) for a in signs for b in signs], "t string")

    def whole(column):
        out = F.translate(column, text.FOLD_FROM, text.FOLD_TO)
        for sign, spelling in (text.SIGN_FOLDS | text.LONG_FOLDS).items():
            out = F.replace(out, F.lit(sign), F.lit(spelling))
        return F.regexp_replace(out, text.COMBINING, "")

    assert df.filter(~text.fold_unicode("t").eqNullSafe(whole(F.col("t")))).count() == 0


@pytest.mark.parametrize("limit", [8, 8 * 2**20])
def test_steps_on_distinct_tokens_give_what_they_give_on_every_token(spark, monkeypatch, limit):
    monkeypatch.setattr(batches, "SLICE_BYTES", limit)
    texts = ["Memperjuangkan pasar-pasar, dan Pasarnya pukul 21.30 WIB", None, "", " . ", "a ib\nib\tdiberikan 2x makanan", "kata Katanya 😀 Straße жук"] * 3
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    words, options = ["dan", "kata"], {"protected": ["memperjuangkan"], "overrides": {"makanan": "santap"}}
    steps = remove_stopwords(stem_tokens(remove_stopwords(tokenize(text.base_clean("t")), words), **options), words)
    together = rows.select(preprocess_text("t", words, **options).alias("together"), steps.alias("steps"))
    found = together.collect()
    assert [r["together"] for r in found] == [r["steps"] for r in found]
    assert found[0]["steps"] == ["memperjuangkan", "pasar", "pasar", "pasar"] and found[4]["steps"] == ["ib", "ib", "beri", "santap"]
    alone = rows.select(preprocess_text("t", words, **options).alias("x"))
    assert "ArrowEvalPython" in plan_of(alone) and "isin" not in plan_of(alone) and "meny" not in plan_of(alone)


@pytest.mark.parametrize("limit", [8, 8 * 2**20])
def test_counts_of_a_slice_stay_with_their_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(batches, "SLICE_BYTES", limit)
    lists = [["b", "a", "b"], [], None, ["c", None, "c"], ["é", "z", "z"], ["b"]]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, t array<string>").coalesce(1)
    found = {r["i"]: [tuple(x) for x in r["n"]] for r in rows.select("i", run_lengths("t").alias("n")).collect()}
    assert found == {0: [("a", 1), ("b", 2)], 1: [], 2: [], 3: [(None, 1), ("c", 2)], 4: [("z", 2), ("é", 1)], 5: [("b", 1)]}


@pytest.mark.parametrize("gap", ["", " "])
def test_one_table_folds_as_emoji_and_unicode_rules_in_turn(spark, gap):
    codes = [c for c in [*range(1, 0x3400), *range(0xFB00, 0xFB10), *range(0xFE00, 0xFE10), *range(0x1F000, 0x1FB00), *range(0xE0010, 0xE0090)]]
    rows = spark.createDataFrame([(f"a{chr(c)}b" + ("é\U0001f600" if c % 2 else ""),) for c in codes] + [(None,), ("",)], "t string")
    in_turn = text.fold_unicode(text.strip_emoji("t", gap))
    assert rows.filter(~text.fold_signs("t", gap).eqNullSafe(in_turn)).count() == 0
    assert "ArrowEvalPython" in plan_of(rows.select(text.base_clean("t")))
