import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions import text as T


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("x"))).collect()]


def python_normal(s):
    s = unicodedata.normalize("NFKC", s).translate(str.maketrans(*T.UPPER)).lower().replace("̇", "")
    return " ".join(s.translate(str.maketrans(*T.FOLD)).split())


def test_normalize(spark):
    said = ["BİLGİSAYAR MÜHENDİSLİĞİ", "bilgisayar muhendisligi", "Yazılım Mühendisliği", "IŞIK ÇAĞLAR", "Doç. Dr.   Emine   BAŞ", "ﬁ x", "i̇z", "", None]
    want = ["bilgisayar muhendisligi", "bilgisayar muhendisligi", "yazilim muhendisligi", "isik caglar", "doc. dr. emine bas", "fi x", "iz", "", None]
    assert column(spark, said, T.normalize_tr) == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_categories=("Cs", "Cn", "Co", "Cc"), max_codepoint=0x2FFF), max_size=30), min_size=1, max_size=60))
def test_normalize_like_python(spark, texts):
    got = column(spark, texts, T.normalize_tr)
    for g, s in zip(got, texts, strict=True):
        if s.lower() == "".join(c.lower() for c in s):  # final sigma has its own rule
            assert g == python_normal(s)


def test_tokens(spark):
    assert column(spark, ["Ne zaman staj yapılır? A b2 café", "", None], T.tokenize_tr) == [["staj", "yapilir", "b2", "caf"], [], None]
    assert column(spark, ["ne a b2"], lambda c: T.tokenize_tr(c, stop_words=False)) == [["ne", "a", "b2"]]


def test_words_and_lines(spark):
    said = ["a  b c\n d", "", " \n ", None]
    assert column(spark, said, T.word_count) == [4, 0, 0, 0]
    assert column(spark, said, T.words_of) == [["a", "b", "c", "d"], [], [], None]
    assert column(spark, said, T.filled_lines) == [["a  b c", " d"], [], [], None]
    assert column(spark, said, T.strip) == ["a  b c\n d", "", "", None]
