import pytest
from pyspark.sql import functions as F

from lokalis.functions import classify, text


def one(spark, f, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(f(F.col("v"))).collect()]


@pytest.mark.parametrize("value,want", [("12,345", 12345), ("1.2k", 1200), ("136 Monthly", 136), ("3 m", 3_000_000), ("3 min", 3), ("n/a", None), ("1.2.3", None), ("2.5", 2), ("3.5", 4), (None, None), ("", None), ("7.", 7)])
def test_parse_count(spark, value, want):
    assert one(spark, text.parse_count, value) == [want]


def test_normalisers_differ(spark):
    v = "Straße – Café (קפה) & Bar"
    assert one(spark, text.join_name, v) == ["strasse café קפה bar"]
    assert one(spark, text.base_name, v, "(all)", "A - b") == ["Straße", "(all)", "A"]
    assert one(spark, text.ascii_fold, "Café", "קפה") == ["cafe", ""]
    assert set(one(spark, text.calibration_keys, "Agnes (אגנס)")[0]) == {"agnes", "אגנס", "agnesאגנס"}
    assert one(spark, text.locality, "Tel Aviv-Jaffa, Israel") == ["tel aviv jaffa"]
    assert one(spark, text.list_key, "Bars (12)", "Bars · 3 places", " BARS ") == ["bars", "bars", "bars"]
    assert one(spark, text.scope_slug, "São Paulo!", "אב") == ["sao-paulo", "unnamed"]
    assert one(spark, text.city_slug, "São Paulo!", "תל אביב") == ["sao-paulo", "תל-אביב"]
    assert one(spark, text.split_names, "A & B, C") == [["A", "B", "C"]]
    assert one(spark, text.category_parts, "Bar, , קפה, Café  Noir", None) == [["bar", "", "cafe noir"], []]


def test_parsers(spark):
    assert one(spark, text.slug_of_url, "https://x/v/the-bar/12", "https://x/v/the-bar/", None)[:2] == ["the-bar", ""]
    assert one(spark, text.strict_count, "2,628", "", "²", "-1", None) == [2628, None, None, None, None]
    assert one(spark, text.number_or_null, "1.5", "nan", "inf", "x", None) == [1.5, None, None, None, None]
    assert one(spark, text.radius_km, "5", "3 mi", "800m") == [5.0, pytest.approx(4.828032), pytest.approx(0.8)]
    with pytest.raises(Exception, match="not a radius"):
        one(spark, text.radius_km, "far")
    now = F.lit(1_790_000_000)
    assert one(spark, lambda c: text.retry_after_seconds(c, now, 9), "120", "soon", None) == [120.0, 9.0, 9.0]


def test_agreement_and_kinds(spark):
    df = spark.createDataFrame([("The Old Oak", "old oak pub"), ("The Old Oak", "elm"), ("", "x")], "a string, b string")
    assert [r[0] for r in df.select(text.names_agree(F.col("a"), F.col("b"))).collect()] == [True, False, True]
    assert one(spark, classify.phrase_kind, "American Restaurant, Beer Bar", "Café", "Pub", None) == ["craft_beer_bar", "non_beer", "unsettled", "unsettled"]
    assert one(spark, classify.part_kind, "Pub, Brew Pub") == [("brewery", "brew pub")]
    rows = spark.createDataFrame([(3, 20), (3, None), (4, 50)], "u long, t long")
    assert [r[0] for r in rows.select(classify.possible_home(F.col("u"), F.col("t"))).collect()] == [True, False, False]
