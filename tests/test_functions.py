"""Literal values of the text, measurement and geometry functions."""

import pytest
from pyspark.sql import functions as F

from specaudit.functions import geo, text


def one(spark, column, **values):
    kinds = {str: "string", float: "double", int: "int", bool: "boolean"}
    schema = ", ".join(f"{k} {kinds[type(v)] if v is not None else 'string'}" for k, v in values.items()) or "x int"
    df = spark.createDataFrame([tuple(values.values()) or (1,)], schema)
    return df.select(column.alias("r")).first().r


@pytest.mark.parametrize("cell,expect", [("0.562, 0.596", [0.562, 0.596]), ("3.20 | 4.34", [3.2, 4.34]), ("3.2-4.3", [3.2, -4.3]), ("", []), (None, []), ("none", [])])
def test_numbers(spark, cell, expect):
    assert one(spark, text.numbers(F.col("c")), c=cell) == expect


@pytest.mark.parametrize("label,expect", [("N: 17.6610 E:78. 1068", (17.661, 78.1068)), ("117.2, 78.1", None), ("17.5; 78.25", (17.5, 78.25)), ("nothing", None), (None, None)])
def test_coordinates(spark, label, expect):
    got = one(spark, text.coordinates(F.col("c")), c=label)
    assert (None if got is None else (got.lat, got.lon)) == expect


@pytest.mark.parametrize("value,unit,expect", [(1200.0, "mm", 1.2), (75.0, "cm", 0.75), (2.0, "metres", 2.0), (1.5, "km", 1500.0), (60.0, "km/h", None)])
def test_units(spark, value, unit, expect):
    assert one(spark, text.to_metres(F.col("v"), F.col("u")), v=value, u=unit) == expect


@pytest.mark.parametrize("words,expect", [("The minimum width shall be 3 m", ">="), ("It shall be 3 m", "="), ("commonly 3 m", None), ("not less than 3", ">="), ("not more than 3", "<="), ("more than 3", ">"), ("below 3", "<"), ("shall not exceed 3", "<=")])
def test_comparators(spark, words, expect):
    assert one(spark, text.comparator(F.col("c")), c=words) == expect


def test_measurements_and_tolerance(spark):
    got = one(spark, text.measurements(F.col("c")), c="a 1,200 mm rail, v2.5 m, 80 km/h and 3 metres")
    assert [(m.raw, m.unit, m.value_m) for m in got] == [(1200.0, "mm", 1.2), (80.0, "km/h", None), (3.0, "m", 3.0)]
    t = one(spark, text.tolerance(F.col("c")), c="height 730 +/- 25 mm")
    assert (t.centre, t.spread, t.unit) == (730.0, 25.0, "mm")
    assert one(spark, text.tolerance(F.col("c")), c="height 730 mm") is None


@pytest.mark.parametrize("x,expect", [(3.5, "3.5"), (0.15, "0.15"), (400.0, "400"), (0.0, "0"), (1234567.0, "1.23457e+06"), (0.00001234, "1.234e-05"), (-2.25, "-2.25"), (0.705, "0.705"), (100000.0, "100000")])
def test_number_rendering(spark, x, expect):
    assert one(spark, text.fmt_g(F.col("x")), x=x) == expect == f"{x:g}"


def test_identity_and_ocr(spark):
    got = one(spark, text.standard_identity(F.col("a"), F.col("a")), a="Guidelines IRC:SP:119-2018 on works")
    assert (got.standard_id, got.edition_year) == ("IRC:SP:119", 2018)
    far = one(spark, text.standard_identity(F.col("a"), F.col("b")), a="IRC 73", b="printed 1980 and 2001")
    assert (far.standard_id, far.edition_year) == ("IRC:73", 1980)
    assert one(spark, text.repair_ocr(F.col("a")), a="1RC:SP:73 lRC 86") == "IRC:SP:73 IRC 86"
    assert one(spark, text.section(F.col("a")), a="words\n  4.2 Kerbs and lanes\n# x") == "4.2 Kerbs and lanes"


def test_tags(spark):
    assert one(spark, text.speed_kmph(F.col("a")), a="50 mph") == 80.5
    assert one(spark, text.lane_count(F.col("a")), a=" 4 ") == 4 and one(spark, text.lane_count(F.col("a")), a="31") is None
    assert one(spark, text.road_class(F.col("a"), F.col("b"))["road_class"], a="N5", b="x") == "Expressway"
    assert one(spark, text.road_class(F.col("a"), F.col("b"))["confidence"], a="", b="primary") == 0.6
    assert one(spark, text.tokens(F.col("a")), a="W-beam IRC:SP:84, a 5 m") == ["w-beam", "irc:sp:84", "5"]
    assert one(spark, text.known(F.col("a")), a=" unknown ") is None
    assert one(spark, text.normalize_text(F.col("a")), a=" a\x00 \t b \n  c\n\n\n\nd ") == "a b \nc\n\nd"


def test_geometry(spark):
    c = F.lit
    assert abs(one(spark, geo.distance_m(c(0.0), c(0.0), c(0.0), c(1.0))) - 111194.93) < 0.1
    assert abs(one(spark, geo.bearing(c(0.0), c(0.0), c(0.0), c(1.0))) - 90) < 1e-9
    to = one(spark, geo.destination(c(10.0), c(20.0), c(45.0), c(1000.0)))
    assert abs(one(spark, geo.distance_m(c(10.0), c(20.0), c(to.lat), c(to.lon))) - 1000) < 1e-3
    assert one(spark, geo.heading_difference(c(350.0), c(10.0))) == 20 and one(spark, geo.undirected_difference(c(0.0), c(170.0))) == 10
    line = F.array(*(F.struct(c(a).alias("lat"), c(b).alias("lon")) for a, b in ((0.0, 0.0), (0.0, 1.0))))
    assert abs(one(spark, geo.polyline_distance_m(c(0.001), c(0.5), line)) - 111.19) < 0.1
    df = spark.createDataFrame([(float(x),) for x in (4, 1, 3, 2)], "x double")
    assert df.agg(geo.upper_median("x")).first()[0] == 3.0
    assert spark.createDataFrame([(100.0,), (200.0,)], "x double").agg(geo.nearest_rank("x", 0.95)).first()[0] == 200.0
