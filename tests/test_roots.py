"""Confix stripping against a root table: hand-derived stems, order of look-ups, tables of any size."""

import pytest
from pyspark.sql import functions as F

from wartalens.operators.preprocess import preprocess_documents, preprocess_with_tables, root_stems, stem_by_roots

ROOTS = """ajar baca main masak pukul tulis sapu kirim ambil atur rasa rawat juang tahu duduk hitung ganti bangun laku jalan baik bagus
kerja temu lihat tarik tanya nyanyi milik beli adil raja rangkum wakil proses produksi kait mulai coba ukur buru tani kota kali buku
malaikat lari makan ikan sungguh hidup cinta nilai politik pesta jasa""".split()

# word -> stem, worked out by hand from the published rules
STEMS = {
    "mengajarkan": "ajar", "belajar": "ajar", "pelajaran": "ajar", "membaca": "baca", "dibacakan": "baca", "bacaannya": "baca",
    "pemain": "main", "permainan": "main", "memasak": "masak", "memukul": "pukul", "dipukulnya": "pukul", "menulis": "tulis", "penulisan": "tulis",
    "menyapu": "sapu", "mengirim": "kirim", "pengiriman": "kirim", "mengambil": "ambil", "peraturan": "atur", "perasaan": "rasa",
    "merawat": "rawat", "memperjuangkan": "juang", "ketahui": "tahu", "pengetahuan": "tahu", "didudukkan": "duduk", "perhitungan": "hitung",
    "penggantinya": "ganti", "pembangunan": "bangun", "melakukan": "laku", "berjalan": "jalan", "perbaikan": "baik", "sebagus": "bagus",
    "bekerja": "kerja", "pekerja": "kerja", "ditemukan": "temu", "terlihatlah": "lihat", "menarik": "tarik", "pertanyaanku": "tanya",
    "menyanyi": "nyanyi", "pemilik": "milik", "membelikan": "beli", "keadilan": "adil", "kerajaan": "raja", "merangkum": "rangkum",
    "perwakilan": "wakil", "pemrosesan": "proses", "terkait": "kait", "memulai": "mulai", "percobaan": "coba", "pengukuran": "ukur",
    "buku": "buku", "bukunya": "buku", "bukukupun": "buku", "malaikatmalaikat": "malaikatmalaikat", "makan": "makan", "ikan": "ikan",
    "berlari": "lari", "berlarilah": "lari", "sesungguhnya": "sungguh", "kehidupanmu": "hidup", "mencintai": "cinta", "penilaian": "nilai",
    "tidakdikenal": "tidakdikenal", "xyzkan": "xyzkan", "di": "di", "kan": "kan",
}


def test_hand_derived_stems(spark):
    tokens = spark.createDataFrame([(w,) for w in [*STEMS, *STEMS, None]], "token string")
    roots = spark.createDataFrame([(w,) for w in [*ROOTS, ROOTS[0], None]], "root string")
    got = {r["token"]: r["stem"] for r in root_stems(tokens, roots).collect()}
    assert {w: (got[w], s) for w, s in STEMS.items() if got[w] != s} == {}
    assert len(got) == len(STEMS)


def test_first_look_up_wins(spark):
    """The word itself, then the fewest suffixes off, then prefixes from the shortest form back; forbidden pairs stay."""
    cases = {
        ("berikan", ("berikan", "beri", "ikan")): "berikan", ("berikan", ("beri", "ikan")): "beri", ("berikan", ("ikan",)): "ikan",
        ("mengarang", ("karang", "arang")): "arang", ("mengarang", ("karang",)): "karang", ("dimakan", ("mak", "makan")): "makan",
        ("bukuku", ("buku", "buk")): "buku", ("kan", ("k",)): "kan", ("tertawai", ("tawa",)): "tawa", ("seluruhi", ("luruh",)): "seluruhi",
    }
    for (word, roots), stem in cases.items():
        tokens = spark.createDataFrame([(word,)], "token string")
        assert root_stems(tokens, spark.createDataFrame([(r,) for r in roots], "r string")).first()["stem"] == stem, (word, roots)


@pytest.mark.parametrize("limit", [200_000, 0])
def test_documents_by_roots(spark, limit):
    rows = [(1, ["menulis", "buku", "menulis", None, "asing"]), (None, ["pemain"]), (1, []), (2, None), (3, ["dijaga", "menulis"])]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    roots = spark.createDataFrame([(r,) for r in ROOTS], "r string")
    out = stem_by_roots(docs, roots, protected=["menulis"], overrides={"asing": "asal"}, inline_limit=limit)
    got = sorted(repr((r["doc_id"], r["tokens"])) for r in out.collect())
    want = [(1, ["menulis", "buku", "menulis", None, "asal"]), (None, ["main"]), (1, []), (2, None), (3, ["dijaga", "menulis"])]
    assert got == sorted(map(repr, want))
    assert stem_by_roots(docs, roots.limit(0), inline_limit=limit).count() == len(rows)


def test_whole_preparation_with_tables(spark):
    articles = spark.createDataFrame([
        (1, "JAKARTA - Pemain itu menulis buku di kota."), (2, None), (3, ""), (4, "Dia memukul 3 kali pukul 10.30 WIB"),
    ], "article_id long, content string")
    stopwords = spark.createDataFrame([("itu",), ("di",), ("dia",), ("kota",), ("main",)], "word string")
    roots = spark.createDataFrame([(r,) for r in ROOTS], "r string")
    out = {r["doc_id"]: r["tokens"] for r in preprocess_with_tables(articles, stopwords, roots).collect()}
    assert out == {1: ["tulis", "buku"], 2: [], 3: [], 4: ["pukul", "kali"]}
    words = [r["word"] for r in stopwords.collect()]
    plain = preprocess_with_tables(articles, stopwords).orderBy("doc_id").collect()
    assert plain == preprocess_documents(articles, words).orderBy("doc_id").collect()
    assert preprocess_with_tables(articles.filter(F.lit(False)), stopwords, roots).count() == 0
