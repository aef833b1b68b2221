from __future__ import annotations

from pyspark.sql import functions as F

from pressloom.functions import gkg as G
from pressloom.functions import text as T
from pressloom.functions import time as D


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'double' if isinstance(v, float) else 'string'}" for n, v in values.items()))
    assert df.columns == names
    return df.select(column.alias("x")).first().x


def test_title_hash_ignores_case_and_punctuation(spark):
    a = one(spark, T.title_hash(F.col("t")), t="Науки,  и  Техника!")
    assert a == one(spark, T.title_hash(F.col("t")), t="науки и техника")
    assert one(spark, T.title_hash(F.col("t")), t="!!!") is None
    assert one(spark, T.title_hash(F.col("t")), t=None) is None


def test_outlet_strips_one_prefix(spark):
    assert one(spark, T.outlet(F.col("u")), u="https://user:x@www.m.Site.example:8080/a?b") == "m.site.example"
    assert one(spark, T.outlet(F.col("u")), u="not a url") == ""
    assert one(spark, T.outlet(F.col("u")), u=None) == ""


def test_safe_url(spark):
    for u, want in (("https://a.b", "https://a.b"), ("javascript:alert(1)", "#"), (" HTTP://x ", "HTTP://x"), (None, "#"), ("//x", "#")):
        assert one(spark, T.safe_url(F.col("u")), u=u) == want


def test_entity_cells(spark):
    assert one(spark, T.entity_cell(F.col("a"), F.col("b")), a="The Xinhua News Agency on;NASA;un", b="xinhua news agency;Getty Images") == "xinhua news agency;nasa"
    assert one(spark, T.entity_cell(F.col("a"), F.col("b")), a=None, b=None) == ""


def test_verdict_tokens(spark):
    for t, want in (("Yes", 100), ("нет", 0), ("7", 100), ("5", 0), ("maybe", None), (None, None)):
        assert one(spark, T.verdict(F.col("t")), t=t) == want


def test_clean_title(spark):
    long = "A long headline about the reactor vessel of Loputiv"
    assert one(spark, T.clean_title(F.col("t"), F.col("d")), t=f"{long} {long} - Site", d="site.example") == long
    assert one(spark, T.clean_title(F.col("t"), F.col("d")), t="News of the day - Zim Mail | Zim", d="zimmail.example") == "News of the day"
    assert one(spark, T.clean_title(F.col("t"), F.col("d")), t="Real part - of a title", d="site.example") == "Real part - of a title"
    assert one(spark, T.clean_title(F.col("t"), F.col("d")), t=None, d=None) == ""


def test_plural(spark):
    got = [spark.range(1).select(T.plural_ru(F.lit(n), "a", "b", "c").alias("x")).first().x for n in (1, 2, 5, 11, 12, 21, 22, 111, 112)]
    assert got == ["a", "b", "c", "c", "c", "a", "b", "c", "c"]


def test_cells(spark):
    x = one(spark, G.themes_v2(F.col("c")), c="A,B,12;NOOFF,;  low ,7;X,y;,3")
    assert [(r["name"], r["offset"]) for r in x] == [("A,B", 12), ("LOW", 7)]
    x = one(spark, G.locations_v2(F.col("c")), c="1#n#us#a#b#1#2#f#44;1#n#us#a;1#n#usa#a#b#1#2#f#44;1#n#FR#a#b#1#2#f#x")
    assert [(r["cc"], r["offset"]) for r in x] == [("US", 44)]
    assert one(spark, G.themes_v2(F.col("c")), c=None) == []


def test_stamp(spark):
    for t, want in (("2024-01-02", "2024-01-02 00:00:00"), ("2024/1/2", "2024-01-02 00:00:00"), ("2024-01-02T03:04:05+00:00", "2024-01-02 03:04:05"), ("x", None), (None, None)):
        assert one(spark, D.stamp(F.col("t")).cast("string"), t=t) == want


def test_freshness(spark):
    assert one(spark, D.freshness(F.col("a")), a=0.0) == 1.0
    assert abs(one(spark, D.freshness(F.col("a")), a=4.0) - 0.675) < 1e-12
    assert one(spark, D.freshness(F.col("a"), half_life=0), a=9.0) == 1.0


def test_reply_of_several_lines(spark):
    r = T.reply_parts(F.col("t"))
    assert tuple(one(spark, r, t="Here.\n**Заголовок:** Новый <b>мост</b> \r\nПЕРЕСКАЗ — Первая.\n\nВторая <x>.\n")) == ("Новый <b>мост</b>", "Первая.\n\nВторая <x>.")
    assert tuple(one(spark, r, t="Без меток.\nДва.")) == ("", "Без меток.\nДва.")
    assert tuple(one(spark, r, t=None)) == ("", "")
