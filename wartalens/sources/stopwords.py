"""Stopword lists: built-in general and news words, and lists read from files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# General Indonesian stopwords.
GENERAL = """
yang untuk pada ke para namun menurut antara dia dua ia seperti jika sehingga kembali dan tidak ini karena
kepada oleh saat harus sementara setelah belum kami sekitar bagi serta di dari telah sebagai masih hal ketika
adalah itu dalam bisa bahwa atau hanya kita dengan akan juga ada mereka sudah saya terhadap secara agar lain
anda begitu mengapa kenapa yaitu yakni daripada itulah lagi maka tentang demi dimana kemana pula sambil
sebelum sesudah supaya guna kah pun sampai sedangkan selagi tetapi apakah kecuali sebab selain seolah seraya
seterusnya tanpa agak boleh dapat dsb dst dll dahulu dulunya anu demikian tapi ingin nggak mari nanti
melainkan oh ok seharusnya sebetulnya setiap setidaknya sesuatu pasti saja toh ya walau tolong tentu amat
apalagi bagaimanapun
""".split()

# Words of Indonesian news that carry no topic.
NEWS = """
cnn indonesia kompas kompascom detik detikcom tribunnews tribunnewscom com
jakarta bandung surabaya medan semarang yogyakarta aceh bali papua maluku kalimantan sulawesi nusantara
wib wita wit pukul senin selasa rabu kamis jumat jum'at sabtu minggu hari bulan tahun
januari februari maret april mei juni juli agustus september oktober november desember
ujar kata ungkap tutur lanjut menurut menambahkan menegaskan menyebutkan ucap bilang jelas
foto video simak selengkapnya baca klik berita
netizen warganet trending akun unggah posting sosial media online
nbsp br strong div span
""".split()


def build_stopwords(extra: Iterable[str] = ()) -> list[str]:
    """General, news and extra words, trimmed, lowercase, distinct, sorted."""
    words = [*GENERAL, *NEWS, *(extra or ())]
    return sorted({w.strip().lower() for w in words if w and w.strip()})


def load_stopword_list(spark: SparkSession, path: str, mode: str = "comma") -> DataFrame:
    """Words of a text file; ``mode="comma"`` splits lines at commas, ``"line"`` takes whole lines."""
    if mode not in ("comma", "line"):
        raise ValueError("mode is comma or line")
    lines = spark.read.text(path)
    words = F.explode(F.split("value", ",")) if mode == "comma" else F.col("value")
    return (
        lines.select(F.lower(F.trim(words, F.lit(" \t\r\n"))).alias("word") if mode == "line" else words.alias("word"))
        .select(F.lower(F.trim("word", F.lit(" \t\r\n"))).alias("word"))
        .filter("word <> ''").distinct()
    )


def stopword_table(spark: SparkSession, words: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(w,) for w in sorted(set(words))], "word string")
