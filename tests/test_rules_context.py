"""Evidence checks, validation, context, map matching and evaluation."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from specaudit.functions import geo, text
from specaudit.operators import context, evaluation, rules


@pytest.mark.parametrize("standard,way,lanes,cls,setting,expect", [
    ("IRC:SP:73", "divided", 4, "NH", "rural", "inapplicable"), ("IRC:SP:84", "divided", 4, "NH", "rural", "applicable"), ("IRC:SP:87", "divided", 4, "NH", "rural", "inapplicable"), ("IRC:SP:84-2", None, 4, "NH", "rural", "unknown"),
    ("IRC:SP:99", "divided", 4, "Expressway", "rural", "applicable"), ("IRC:SP:99", "divided", 4, None, "rural", "unknown"), ("IRC:86", None, None, "NH", "rural", "inapplicable"), ("IRC:86", None, None, "NH", "urban", "not_scoped"), ("IRC:5", "divided", 4, "NH", "rural", "not_scoped"), (None, None, None, None, None, "not_scoped"),
])
def test_applicability(spark, standard, way, lanes, cls, setting, expect):
    df = spark.createDataFrame([(standard, way, lanes, cls, setting)], "s string, w string, n int, c string, e string")
    assert df.select(context.applicability(F.lit("min_lane_width"), *(F.col(x) for x in "swnce"))).first()[0] == expect
    assert df.select(context.applicability(F.lit("min_kerb_height"), *(F.col(x) for x in "swnce"))).first()[0] == "not_scoped"


def test_missing_context(spark):
    df = spark.createDataFrame([("NH", "unknown", None, 0.5)], "road_class string, setting string, lanes_total int, confidence double")
    have = {c: F.col(c) for c in ("road_class", "setting", "lanes_total")}
    assert df.select(context.missing_context(F.array(*map(F.lit, have)), have, F.col("road_class"), F.col("confidence"))).first()[0] == ["setting", "lanes_total", "verified_road_class"]


def extraction(spark, **over):
    base = dict(metric_key="min_kerb_height", metric_name="kerb height", hit_text="The kerb  height shall be 150 mm.", quote="the kerb height shall be 150 mm", raw_value=150.0, second_raw_value=None, raw_unit="mm", comparator="=", applies_to=None, conditions=[], context_text="road class: NH") | over
    schema = "metric_key string, metric_name string, hit_text string, quote string, raw_value double, second_raw_value double, raw_unit string, comparator string, applies_to string, conditions array<string>, context_text string"
    return spark.createDataFrame([tuple(base.values())], schema)


@pytest.mark.parametrize("over,expect", [
    ({}, None), ({"hit_text": None}, "unknown_evidence"), ({"quote": ""}, "no_quote"), ({"quote": "other"}, "quote_not_in_passage"), ({"raw_value": None}, "no_value"), ({"raw_unit": "km/h"}, "not_a_length"), ({"comparator": None}, "no_relation"),
    ({"comparator": "range"}, "open_range"), ({"comparator": "range", "second_raw_value": 160.0}, "range_not_stated"), ({"raw_value": 151.0}, "value_not_in_quote"), ({"metric_key": "min_sign_height"}, "other_feature"), ({"comparator": ">="}, "relation_not_stated"),
    ({"metric_key": "min_lane_width", "hit_text": "The toll lane width shall be 3 m", "quote": "The toll lane width shall be 3 m", "raw_value": 3.0, "raw_unit": "m", "comparator": ">="}, "other_facility"),
    ({"metric_key": "min_w_beam_barrier_height", "hit_text": "W-beam and Thrie-beam shall be 1 m", "quote": "W-beam and Thrie-beam shall be 1 m", "raw_value": 1.0, "raw_unit": "m"}, "other_beam"),
    ({"metric_key": "min_w_beam_barrier_height", "hit_text": "W-beam at 730 ± 25 mm", "quote": "W-beam at 730 ± 25 mm", "raw_value": 705.0, "second_raw_value": 755.0, "comparator": "range"}, None),
])
def test_evidence_checks_in_order(spark, over, expect):
    x = extraction(spark, **over)
    got = x.select(rules.evidence_error(x)).first()[0]
    assert got == expect


def test_extraction_order_and_values(spark):
    table = "Minimum radii of horizontal curves. Desirable minimum radius, absolute minimum radius. Plain and rolling 400 m 250 m, Mountainous and steep 150 m 75 m."
    hits = spark.createDataFrame([
        ("a", "min_radius_curvature", 1, "e1", "The radius of a curve is at least 30 m."), ("a", "min_radius_curvature", 2, "e2", table), ("b", "min_w_beam_barrier_height", 1, "e3", "The W-beam rail is at 730 +/- 25 mm."),
        ("c", "min_lane_width", 1, "e4", "Lane width varies. The lane width shall be 3.5 m."), ("c", "min_lane_width", 2, "e5", "The minimum lane width is 3 m."), ("d", "min_kerb_height", 1, "e6", "The kerb height is 150 mm or 200 mm."), ("w", "min_w_beam_barrier_height", 1, "e7", "The W-beam height shall be 0.7 m."),
    ], "request_id string, metric_key string, rank int, evidence_id string, text string")
    ctx = spark.createDataFrame([("a", "plain")], "request_id string, terrain string")
    got = {r.request_id: r for r in rules.extract(hits, ctx).collect()}
    assert (got["a"].raw_value, got["a"].evidence_id, got["a"].direct_table) == (400.0, "e2", True)
    assert (got["b"].raw_value, got["b"].second_raw_value, got["b"].comparator) == (705.0, 755.0, "range")
    assert (got["c"].raw_value, got["c"].comparator, got["c"].evidence_id, len(got["c"].conditions)) == (3.5, ">=", "e4", 1)
    assert "d" not in got and got["w"].raw_value == 0.7


def test_overrides_and_trajectories(spark):
    routes = spark.createDataFrame([("in", 17.5, 78.5, "NH 65"), ("out", 1.0, 1.0, "NH 65"), ("other", 17.5, 78.5, "SH1")], "route_id string, lat double, lon double, highway_ref string")
    o = spark.createDataFrame([(0, "X", "nh65", 17.0, 18.0, 78.0, 79.0)], "position int, id string, highway_ref string, min_lat double, max_lat double, min_lon double, max_lon double")
    assert {r.route_id: r.override_id for r in context.route_overrides(routes, o).collect()} == {"in": "X", "out": None, "other": None}
    pts = spark.range(50).selectExpr("'r' as route_id", "id as pos")
    got = sorted(r.pos for r in context.sample_trajectory(pts, 7).collect())
    assert len(got) == 7 and got[0] == 0 and got[-1] == 49 and got == sorted({round(k * 49 / 6) for k in range(7)})
    assert context.sample_trajectory(pts.where("pos < 3"), 7).count() == 3


def test_points_without_a_way_nearby_stay(spark):
    points = spark.createDataFrame([(1, 17.0, 78.0), (2, 40.0, 10.0)], "point_id int, lat double, lon double")
    ways = spark.createDataFrame([("w", [(17.0, 78.001), (17.01, 78.001)])], "way_id string, geometry array<struct<lat:double,lon:double>>")
    got = {r.point_id: (r.way_id, r.metres) for r in context.nearest_way(points, ways, most_m=5000.0).collect()}
    assert got[1][0] == "w" and 100 < got[1][1] < 110 and got[2] == (None, None)
    far = {r.point_id: (r.way_id, r.metres) for r in context.nearest_way(points.unionByName(spark.createDataFrame([(3, None, 1.0)], points.schema)), ways).collect()}
    assert far[1] == got[1] and far[2][0] == "w" and far[2][1] > 1e6 and far[3] == (None, None)
    none = context.nearest_way(points, ways.where("way_id = 'no'"))
    assert {r.way_id for r in none.collect()} == {None} and none.count() == 2


@pytest.mark.parametrize("cell,seed", [(0.01, 1), (0.5, 2)])
def test_nearest_way_is_that_of_all_pairs(spark, cell, seed):
    rng = random.Random(seed)
    place = lambda: (rng.choice([rng.uniform(10, 12), rng.uniform(-70, 80)]), rng.choice([rng.uniform(70, 71), rng.uniform(-170, 170)]))
    shapes = []
    for k in range(120):
        a = place()
        kind = k % 4
        shapes.append((k, [a] if kind == 0 else [a, place()] if kind == 1 else [(a[0] + 0.001 * j, a[1] + rng.uniform(0, 0.002)) for j in range(rng.randrange(1, 9))]))
    shapes += [(500, []), (501, None), (1, shapes[1][1])]
    rows = [(k, *place()) for k in range(150)] + [(900, *shapes[2][1][0])]
    points = spark.createDataFrame(rows, "point_id int, lat double, lon double")
    ways = spark.createDataFrame(shapes, "way_id int, geometry array<struct<lat:double,lon:double>>")
    pairs = points.crossJoin(ways.where("size(geometry) > 0")).withColumn("m", F.round(geo.polyline_distance_m(F.col("lat"), F.col("lon"), F.col("geometry")), 6))
    expect = {r.point_id: (r.b.way_id, r.b.m) for r in pairs.groupBy("point_id").agg(F.min(F.struct("m", "way_id")).alias("b")).collect()}
    assert {r.point_id: (r.way_id, r.metres) for r in context.nearest_way(points, ways, cell).collect()} == expect


def test_opposite_carriageways_against_all_pairs(spark):
    rng = random.Random(5)
    ways = []
    for k in range(500):
        lat, lon, up = rng.choice([0.0, 17.0, -45.0, 70.0]) + rng.uniform(0, 0.01), 78 + rng.uniform(0, 0.01), rng.choice([1, -1])
        ways.append((f"w{k}", "trunk", rng.choice(["NH 65", "nh65", "SH1", None]), rng.choice(["Main  Road", "main road", None]), rng.choice(["yes", "-1", "no"]), [(lat + up * 0.0004 * j, lon + rng.uniform(0, 0.0002)) for j in range(rng.randrange(1, 6))]))
    df = spark.createDataFrame(ways, "way_id string, highway string, ref string, name string, oneway string, geometry array<struct<lat:double,lon:double>>")

    def metres(p, q):
        h = math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return 2 * 6_371_000.0 * math.asin(math.sqrt(h))

    def heading(w):
        (a, b), (c, d) = w[5][0], w[5][-1]
        y = math.sin(math.radians(d - b)) * math.cos(math.radians(c))
        x = math.cos(math.radians(a)) * math.sin(math.radians(c)) - math.sin(math.radians(a)) * math.cos(math.radians(c)) * math.cos(math.radians(d - b))
        return (math.degrees(math.atan2(y, x)) + (180 if w[4] == "-1" else 0)) % 360

    def road(w):
        return ("r", w[2].replace(" ", "").lower()) if w[2] else ("n", " ".join(w[3].split()).lower()) if w[3] else None

    one = [w for w in ways if w[4] != "no" and len(w[5]) >= 2 and road(w)]
    expect = {}
    for v in one:
        for w in one:
            if v[0] != w[0] and road(v) == road(w) and abs((heading(v) - heading(w) + 180) % 360 - 180) >= 120:
                d = round(min(metres(p, q) for p in v[5] for q in w[5]), 6)
                if d <= 80:
                    expect[v[0]] = min(expect.get(v[0], (d, w[0])), (d, w[0]))
    got = {r.way_id: (r.metres, r.other_id) for r in context.opposite_carriageways(df).collect()}
    assert got.keys() == expect.keys() and len(expect) > 20
    assert all(abs(got[k][0] - d) < 1e-5 and got[k][1] == o for k, (d, o) in expect.items())


WAYS = "way_id string, highway string, ref string, name string, oneway string, geometry array<struct<lat:double,lon:double>>, lanes string, dual_carriageway string, divider string"


def test_carriageways_are_paired(spark):
    line = lambda lat, back=False: [(lat, 78.1), (lat, 78.0)] if back else [(lat, 78.0), (lat, 78.1)]
    ways = spark.createDataFrame([
        ("a", "trunk", "NH 65", None, "yes", line(17.0), "2", None, None), ("b", "trunk", "NH65", None, "yes", line(17.0003, True), "2", None, None), ("c", "trunk", "NH65", None, "yes", line(17.5), "3", None, None),
        ("d", "trunk", "NH9", None, None, line(18.0), "4", None, None), ("e", "trunk", None, "Ring  Road", "yes", line(19.0), "2", None, None), ("f", "trunk", None, "ring road", "-1", line(19.0002), "3", None, None),
    ], WAYS)
    pairs = context.opposite_carriageways(ways)
    assert {r.way_id: r.other_id for r in pairs.collect()} == {"a": "b", "b": "a", "e": "f", "f": "e"}
    got = {r.way_id: (r.carriageway, r.osm_total_lanes, r.total_road_lanes) for r in context.lane_context(ways, pairs).collect()}
    assert got["a"] == ("divided", 4, 4) and got["c"] == ("one_way", None, None) and got["d"] == ("undivided", 4, 4) and got["e"] == ("divided", 5, None)


def test_route_class_follows_the_trajectory(spark):
    route = spark.createDataFrame([("r", k, 17.0, 78.0 + 0.001 * k) for k in range(11)], "route_id string, pos int, lat double, lon double")
    along = [(17.0001, 77.99), (17.0001, 78.02)]
    cross = lambda k: [(16.99, 78.0 + 0.003 * k), (17.01, 78.0 + 0.003 * k)]
    ways = spark.createDataFrame([("r", "main", "National Highway", 0.92, along, None)] + [("r", f"x{k}", "Local Street", 0.6, cross(k), None) for k in range(3)], "route_id string, way_id string, road_class string, confidence double, geometry array<struct<lat:double,lon:double>>, oneway string")
    got = context.classify_route(route, ways).first()
    assert got.road_class == "National Highway" and got.way_id == "main" and 0.85 < got.confidence <= 0.95
    assert context.vote_class(ways).first().road_class == "Local Street"


def test_sheet_context(spark):
    from specaudit.plans.engine import CONTEXT

    rows = [("r", "2", "1", "2", "Chevron"), ("r", "2", "1", "2", "Warning Sign"), ("r", "2", "1", "2", "Mandatory Sign: speed limit 80"), ("s", "4", "0", "2", "x"), ("p", "2", None, None, "x")]
    df = spark.createDataFrame(rows, "route_id string, `Expected Total Lanes` string, `Centre Lanes Detected` string, `Shoulder Lanes Detected` string, `Traffic Sign Class` string")
    sheet = context.from_sheet(df)
    got = {r.route_id: r for r in sheet.collect()}
    assert (got["r"].lanes, got["r"].carriageway, got["r"].sign_mounting, got["r"].posted_speed_kmph) == (2, "undivided", "shoulder", 80.0)
    assert (got["s"].carriageway, got["s"].sign_class, got["s"].sign_mounting) == ("divided", "x", None)
    kinds = spark.createDataFrame([], CONTEXT.replace("request_id", "route_id", 1)).schema
    given = [{"route_id": "r"}, {"route_id": "s"}, {"route_id": "p", "carriageway": "divided", "carriageway_count": 2, "osm_way_lanes": 2, "opposite_carriageway_lanes": 3}, {"route_id": "none", "lanes_total": 6}]
    full = context.with_sheet(spark.createDataFrame([tuple(g.get(n) for n in kinds.names) for g in given], kinds), sheet)
    got = {r.route_id: r for r in full.collect()}
    assert (got["r"].total_road_lanes, got["r"].carriageway, got["r"].lanes_provisional, got["r"].posted_speed_kmph) == (2, "undivided", True, 80.0)
    assert (got["s"].total_road_lanes, got["s"].lanes_per_carriageway) == (None, 4)
    assert (got["p"].total_road_lanes, got["p"].lanes_per_carriageway, got["p"].lanes_provisional) == (4, 2, True)
    assert (got["none"].total_road_lanes, got["none"].lanes_provisional) == (6, False)
    lines = {r[0]: r[1] for r in full.select("route_id", context.render(full)).collect()}
    assert lines["r"] == "jurisdiction: India; carriageway: undivided; carriageway count: 1; base through-lane total: 2; lane configuration status: provisional; posted speed: 80 km/h (numbered speed-limit sign detected in input workbook); radius speed basis: detected_posted_speed_proxy; sign mounting: shoulder"


def test_evaluation_summary(spark):
    base = "metric_key string, first_rank int, citation_match boolean, standard_match boolean, edition_match boolean, value_match boolean, comparator_match boolean, applicability_match boolean, audit_decision_match boolean, expected_abstention boolean, predicted_abstention boolean, total_latency_ms double"
    rows = [("m", 1, True, True, None, True, True, True, None, True, True, 100.0), ("m", 10, False, True, None, True, True, True, None, False, False, 200.0)]
    df = evaluation.case_records(spark.createDataFrame(rows, base))
    s = evaluation.summarize(df).first()
    assert (s.recall_at_5, s.recall_at_10, s.mrr, s.citation_accuracy, s.edition_accuracy, s.abstention_precision, s.abstention_recall, s.overall_correct) == (0.5, 1.0, 0.55, 0.5, None, 1.0, 1.0, 0.5)
    assert evaluation.latency(df).first() == ("m", 2, 150.0, 150.0, 200.0)


def test_routes_resolve_from_map_features(spark):
    pts = spark.createDataFrame([("r", k, 17.0, 78.0 + 0.001 * k) for k in range(12)] + [("lost", 0, 1.0, 1.0)], "route_id string, pos long, lat double, lon double")
    tags = {"highway": "trunk", "ref": "NH 65", "lanes": "2", "maxspeed": "80"}
    rows = [("r", "w1", tags, [(17.0, 77.99), (17.0, 78.02)]), ("r", "w2", tags | {"maxspeed": "50 mph"}, [(17.0001, 78.0), (17.0001, 78.02)]), ("r", "foot", {"highway": "footway"}, [(17.0, 78.0), (17.0, 78.02)]), ("r", "z", {"landuse": "residential"}, [])]
    features = spark.createDataFrame(rows, "route_id string, way_id string, tags map<string,string>, geometry array<struct<lat:double,lon:double>>")
    cross = context.cross_points(pts)
    assert cross.count() == 14
    heights = cross.withColumn("elevation", F.when(F.col("side") > 0, 100.0).otherwise(40.0))
    got = {r.route_id: r for r in context.resolve_routes(pts, features, heights).collect()}
    r = got["r"]
    assert (r.road_class, r.highway_ref, r.setting, r.carriageway, r.total_road_lanes, r.posted_speed_kmph, r.terrain) == ("National Highway", "NH 65", "urban", "undivided", 2, 80.5, "rolling")
    assert r.osm_maxspeed_values_kmph == [80.0, 80.5] and got["lost"].road_class is None and got["lost"].terrain == "unknown"
    bare = features.withColumn("geometry", F.array().cast("array<struct<lat:double,lon:double>>"))
    assert {x.route_id: x.road_class for x in context.resolve_routes(pts, bare).collect()}["r"] == "National Highway"


def test_nearest_way_searches_a_place_and_a_shape_once(spark, monkeypatch):
    points = spark.range(3000).select(F.col("id").alias("point_id"), (17 + F.col("id") % 5 * 0.01).alias("lat"), F.lit(78.0).alias("lon"))
    at = lambda x: F.struct((17 + F.col("id") % 3 * 0.01).alias("lat"), x.alias("lon"))
    ways = spark.range(900).select((900 - F.col("id")).alias("way_id"), F.array(at(F.lit(78.001)), at(F.lit(78.5))).alias("geometry"))
    met, plain = [], context._in_ring
    monkeypatch.setattr(context, "_in_ring", lambda open_, parts, *rest: met.append((open_.count(), parts.count())) or plain(open_, parts, *rest))
    got = context.nearest_way(points, ways).groupBy("point_id").agg(F.count("metres").alias("n"), F.min("way_id").alias("w"), F.min("metres").alias("m")).collect()
    assert len(got) == 3000 and {r.n for r in got} == {1} and {(r.point_id % 5, r.w) for r in got} == {(0, 3), (1, 2), (2, 1), (3, 1), (4, 1)}
    assert max(p for p, _ in met) <= 5 and max(w for _, w in met) <= 3


def test_classified_routes_are_not_sent_through_the_driver(spark):
    n = F.col("route_id")
    routes = spark.range(40).select(F.col("id").alias("route_id"))
    points = routes.select("route_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("pos")).select("route_id", "pos", (17 + F.col("pos") * 0.001).alias("lat"), F.lit(78.0).alias("lon"))
    at = lambda y, x: F.struct(y.alias("lat"), x.alias("lon"))
    ways = routes.select("route_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("way_id")).select("route_id", "way_id", F.concat(F.lit("class "), (F.col("way_id") % 2).cast("string")).alias("road_class"), F.lit(0.9).alias("confidence"), F.array(at(F.lit(17.0), 78 + F.col("way_id") * 0.0001), at(F.lit(17.006), 78 + F.col("way_id") * 0.0001)).alias("geometry"), F.lit(None).cast("string").alias("oneway"))
    out = context.classify_route(points, ways)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.road_class, r.way_id) for r in out.collect()} == {("class 0", 0)} and out.where(n.isNotNull()).count() == 40


def test_votes_of_equal_sums_tie_in_any_order(spark):
    def vote(rows):
        return [(r.route_id, r.road_class) for r in context.vote_class(spark.createDataFrame(rows, "route_id int, road_class string, confidence double").coalesce(1)).collect()]

    # 45 times 0.92 is 46 times 0.90
    assert vote([(1, "National Highway", 0.92)] * 45 + [(1, "State Highway", 0.90)] * 46) == [(1, "State Highway")]
    assert vote([(1, "State Highway", 0.92)] * 45 + [(1, "National Highway", 0.90)] * 46) == [(1, "State Highway")]


def test_tolerance_quote_is_that_of_a_search_from_the_start(spark):
    rng, tol = random.Random(3), text.TOLERANCE.replace("(?i)", "")
    piece = lambda: rng.choice(["w beam", "730 +/- 25 mm", "a12 +/- 3 mm", "1,200 plus or minus 5 cm", "x" * rng.randrange(1, 320), " ", "\U0001f6e3", "7.5 mm", "."])
    rows = [(k, rng.choice([" ", ""]).join(piece() for _ in range(rng.randrange(1, 12)))) for k in range(600)] + [(1000, "y" * 301 + "12 +/- 3 mm"), (1001, "y" * 299 + " 12 +/- 3 mm 40 +/- 1 mm")]
    df = spark.createDataFrame(rows, "k int, t string").where(F.col("t").rlike(text.TOLERANCE)).select(rules.tolerance_quote(F.col("t")).alias("got"), F.regexp_extract("t", f"(?i)(.{{0,300}}{tol})", 1).alias("expect"))
    assert df.count() > 200 and df.where("got <> expect").count() == 0


def test_w_beam_quote_of_a_long_passage_is_found_in_time(spark):
    # tried from each of its characters, the passage takes hundreds of millions of steps
    h = spark.range(8).selectExpr("id as request_id", "'min_w_beam_barrier_height' as metric_key", "1 as rank", "'e' as evidence_id", "concat('W beam ', repeat('9 8 ', 400000), ' 730 +/- 25 mm') as text")
    start = time.monotonic()
    got = rules.extract_tolerances(h).select("raw_value", "quote").collect()
    assert [r.raw_value for r in got] == [705.0] * 8 and {len(r.quote) for r in got} == {313} and time.monotonic() - start < 30


def test_forms_of_hits_are_not_made_for_each_pair(spark):
    gold = spark.createDataFrame([(1, "r", None, None, "The  RAIL", None, None, None), (2, "r", None, None, "post", None, None, None)], "case_id int, request_id string, expected_evidence_id string, expected_content_hash string, expected_quote string, expected_edition_year int, expected_page int, expected_standard_id string")
    hits = spark.createDataFrame([("r", 1, "E1", "h", 2000, 1, "s", "no"), ("r", 2, "E2", "i", 2000, 1, "s", "see the\nrail")], "request_id string, rank int, evidence_id string, content_hash string, edition_year int, page int, standard_id string, text string")
    out = evaluation.first_matches(gold, hits)
    assert {r.case_id: r.first_rank for r in out.collect()} == {1: 2, 2: None}
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in x]
    assert joins and not any("regexp_replace" in x for x in joins)


def test_opposite_carriageways_search_a_spot_once_and_near_ones_first(spark, monkeypatch):
    seen, within = [], context._opposite_within
    monkeypatch.setattr(context, "_opposite_within", lambda open_, spots, key, reach: seen.append((open_.count(), spots.count(), reach)) or within(open_, spots, key, reach))
    up, down = [(17.0, 78.0), (17.01, 78.0)], [(17.01, 78.0), (17.0, 78.0)]
    rows = [(k, "trunk", "NH 65", None, "yes", down if k % 2 else up) for k in range(2000)]
    # one partner farther off, and a way given twice with both courses, which is not its own partner
    rows += [(5000, "trunk", "SH1", None, "yes", up), (5001, "trunk", "SH1", None, "yes", [(17.01, 78.0005), (17.0, 78.0005)]), (6000, "trunk", "SH2", None, "yes", up), (6000, "trunk", "SH2", None, "yes", down), (6001, "trunk", "SH2", None, "yes", [(17.0, 78.0006), (17.01, 78.0006)])]
    ways = spark.createDataFrame(rows, "way_id int, highway string, ref string, name string, oneway string, geometry array<struct<lat:double,lon:double>>")
    got = {r.way_id: (r.other_id, round(r.metres)) for r in context.opposite_carriageways(ways).collect()}
    assert got == {k: (1 - k % 2, 0) for k in range(2000)} | {5000: (5001, 53), 5001: (5000, 53), 6000: (6001, 64), 6001: (6000, 64)}
    assert [(n, m) for n, m, _ in seen] == [(14, 14), (10, 14), (10, 14)] and [r for *_, r in seen] == [5.0, 20.0, 80.0]
