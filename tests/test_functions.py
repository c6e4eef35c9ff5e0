from datetime import date

import pytest
from pyspark.sql import functions as F

from newsquant.functions import events as fn
from newsquant.functions import finance as fin


def one(spark, expr, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(
        f"{n} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'date' if isinstance(v, date) else 'int'}"
        for n, v in values.items()))
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [("2011-03-04", date(2011, 3, 4)), ("3/4/2011", date(2011, 3, 4)), ("11/24/2000", date(2000, 11, 24)), ("junk", None)])
def test_mixed_dates(spark, text, want):
    assert one(spark, fn.parse_mixed_date("t"), t=text) == want


def test_day_arithmetic(spark):
    assert one(spark, fn.days_since_published("a", "b"), a=date(2015, 1, 1), b=date(2015, 1, 3)) == -2
    assert one(spark, fn.days_since_epoch("a"), a=date(1970, 1, 11)) == 10
    assert one(spark, fn.parse_day("t"), t="20150230") is None


@pytest.mark.parametrize("quad,verbal,cooperative,weight", [(1, 1, 1, 1), (2, 0, 1, 2), (3, 1, 0, -1), (4, 0, 0, -2)])
def test_quad_class(spark, quad, verbal, cooperative, weight):
    assert one(spark, fn.is_verbal("q"), q=quad) == verbal
    assert one(spark, fn.is_cooperative("q"), q=quad) == cooperative
    assert one(spark, fn.quad_impact("q"), q=quad) == weight


def test_clean_name(spark):
    assert one(spark, fn.clean_name("n"), n="  The KING  of\tSpain ") == "king spain"
    assert one(spark, fn.clean_name("n"), n="the of") == ""


@pytest.mark.parametrize("url,want", [
    ("http://www.news.co.uk/a/b?x=1", "news"), ("https://example.com", "example"), ("http://a.b.example.org:80/x", "example"),
    ("http://localhost/x", "localhost"), ("http://site.de/", "site"),
])
def test_url_domain(spark, url, want):
    assert one(spark, fn.url_domain("u"), u=url) == want


@pytest.mark.parametrize("code,missing,want", [("1", "zero", 0), ("5", "zero", 4), ("0", "zero", None), ("0", "last", 4), ("6", "zero", None), ("---", "zero", None), (None, "zero", None)])
def test_one_hot_index(spark, code, missing, want):
    assert one(spark, fn.one_hot_index("c", 5, missing), c=code) == want


def test_types_of_actor(spark):
    df = spark.createDataFrame([("GOV", "GOV", ""), ("", None, ""), ("A", "", "B")], "a string, b string, c string")
    got = [r[0] for r in df.select(fn.distinct_types(["a", "b", "c"])).collect()]
    assert got == [["GOV"], [""], ["A", "B"]]


def test_zero_impact_is_negative(spark):
    assert one(spark, fn.impact_column_name("c", "t", "v"), c="USA", t="", v=0.0) == "USA_empty_neg"
    assert one(spark, fn.impact_column_name("c", "t", "v"), c="USA", t="GOV", v=0.5) == "USA_GOV_pos"


def test_band_and_sign(spark):
    assert [one(spark, fn.band_label("x"), x=v) for v in (0.01, -0.01, 0.0)] == [1, -1, None]
    assert one(spark, fn.sign_label("x"), x=0.0) == 0


def test_kelly_fraction(spark):
    assert one(spark, fin.kelly_fraction("e", "v", 0.01), e=0.005, v=0.02) == 0
    assert one(spark, fin.kelly_fraction("e", "v", 0.01), e=-0.03, v=0.02) == pytest.approx(-1.0)
    assert one(spark, fin.kelly_fraction("e", "v"), e=0.05, v=0.02) == pytest.approx(2.5)


def test_empty_fields(spark):
    df = spark.createDataFrame([("", None, "x")], "a string, b string, c string")
    assert df.select(fn.empty_fields(["a", "b", "c"]).alias("n"), fn.well_formed(["a", "b"], 1).alias("ok")).first() == (2, False)
    assert df.select(fn.zero_if_empty("a")).first()[0] == "0"
    assert df.select(fn.contains_keyword(F.lit("http://X/ReF"), "rEf")).first()[0]
