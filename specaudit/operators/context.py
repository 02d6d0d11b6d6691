"""Road context: applicability of standards, missing facts, map features, route overrides, overlays."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specaudit.functions import geo, text
from specaudit.plans.catalog import MANUALS, SCOPED
from specaudit.sources.versions import cut

# Labels of a rendered context, in order.
RENDERED = (
    ("jurisdiction", "jurisdiction"), ("road_class", "road class"), ("highway_ref", "highway reference"), ("setting", "setting"), ("terrain", "terrain"), ("carriageway", "carriageway"), ("osm_way_lanes", "lanes on OSM way"),
    ("lanes_per_carriageway", "lanes per carriageway"), ("opposite_carriageway_lanes", "opposite carriageway lanes"), ("osm_total_lanes", "raw OSM total lanes"), ("carriageway_count", "carriageway count"), ("total_road_lanes", "base through-lane total"),
    ("__status", "lane configuration status"), ("__design", "verified design speed"), ("__posted", "posted speed"), ("__basis", "radius speed basis"), ("sign_class", "sign class"), ("sign_mounting", "sign mounting"), ("barrier_type", "barrier type"),
)
NOTHING_KNOWN = "jurisdiction: India; road context otherwise unknown"


def of_standard(standard_id: Column, name: str) -> Column:
    """The standard itself or one of its parts (``id-..``)."""
    s = F.upper(F.trim(standard_id))
    return (s == name) | s.startswith(f"{name}-")


def applicability(metric_key: Column, standard_id: Column, carriageway: Column, total_lanes: Column, road_class: Column, setting: Column) -> Column:
    """applicable, inapplicable, unknown or not_scoped."""
    way = F.coalesce(text.known(carriageway), F.lit("unknown"))
    out = F.when(of_standard(standard_id, "IRC:86"), F.when(F.coalesce(setting == "rural", F.lit(False)), "inapplicable").otherwise("not_scoped")).otherwise("not_scoped")
    cls = F.lower(F.coalesce(road_class, F.lit("")))
    out = F.when(of_standard(standard_id, "IRC:SP:99"), F.when(cls == "", "unknown").when(cls.contains("expressway"), "applicable").otherwise("inapplicable")).otherwise(out)
    for name, expected, lanes in MANUALS:
        own = F.when((way != "unknown") & (way != expected), "inapplicable").when(total_lanes.isNotNull() & (total_lanes != lanes), "inapplicable").when((way == "unknown") | total_lanes.isNull(), "unknown").otherwise("applicable")
        out = F.when(of_standard(standard_id, name), own).otherwise(out)
    return F.when(~metric_key.isin(*SCOPED) | standard_id.isNull(), "not_scoped").otherwise(out)


def context_multiplier(metric_key: Column, standard_id: Column, status: Column, road_class: Column) -> Column:
    """How much a request's context speaks for a standard; expressways are judged first."""
    express = F.lower(F.coalesce(road_class, F.lit(""))).contains("expressway")
    by_status = F.when(status == "applicable", 1.65).when(status == "unknown", 0.72).otherwise(1.0)
    own = F.when(express, F.when(F.upper(standard_id).startswith("IRC:SP:99"), 1.4).otherwise(0.9)).otherwise(by_status)
    return F.when(metric_key.isin(*SCOPED), own).otherwise(1.0)


def missing_context(required: Column, have: dict[str, Column], road_class: Column, confidence: Column) -> Column:
    """Required facts that are not known, and the road class if it is weakly supported."""
    is_known = F.create_map(*(x for k, v in have.items() for x in (F.lit(k), text.known(v.cast("string")).isNotNull())))
    absent = F.filter(required, lambda f: ~F.coalesce(F.try_element_at(is_known, f), F.lit(False)))
    weak = F.array_contains(required, "road_class") & text.known(road_class).isNotNull() & (F.coalesce(confidence, F.lit(0.0)) < 0.65)
    return F.when(weak, F.concat(absent, F.array(F.lit("verified_road_class")))).otherwise(absent)


def missing_configuration(carriageway: Column, total_lanes: Column) -> Column:
    way = F.when(F.coalesce(text.known(carriageway), F.lit("unknown")) == "unknown", "verified_carriageway")
    return F.filter(F.array(way, F.when(total_lanes.isNull(), "verified_total_road_lanes")), lambda x: x.isNotNull())


def radius_speed_basis(design: Column, posted: Column, source: Column) -> Column:
    s = F.lower(F.coalesce(source, F.lit("")))
    proxy = F.when(s.contains("openstreetmap") | s.contains("osm"), "osm_posted_speed_proxy").otherwise("detected_posted_speed_proxy")
    return F.when(design.isNotNull(), "verified_design_speed").when(posted.isNotNull(), proxy).otherwise("unknown")


def render(df: DataFrame) -> Column:
    """The context as one line, known fields only, in fixed order; columns that ``df`` lacks are unknown."""

    def col(name: str, kind: str = "string") -> Column:
        return df[name].cast(kind) if name in df.columns else F.lit(None).cast(kind)

    def speed(c: str, default: str) -> Column:
        source = F.coalesce(F.nullif(col(f"{c}_speed_source"), F.lit("")), F.lit(default))
        return F.when(col(f"{c}_speed_kmph", "double") > 0, F.concat(text.fmt_g(col(f"{c}_speed_kmph", "double")), F.lit(" km/h ("), source, F.lit(")")))

    made = {
        "jurisdiction": F.coalesce(col("jurisdiction"), F.lit("India")), "__status": F.when(col("lanes_provisional", "boolean"), "provisional"), "__design": speed("design", "verified input"), "__posted": speed("posted", "unverified source"),
        "__basis": radius_speed_basis(col("design_speed_kmph", "double"), col("posted_speed_kmph", "double"), col("posted_speed_source")),
    }
    line = F.concat_ws("; ", *(F.concat(F.lit(f"{label}: "), text.known(made.get(c, col(c)))) for c, label in RENDERED))
    return F.when(line == "", NOTHING_KNOWN).otherwise(line)


def overlay(supplied: DataFrame, resolved: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Supplied facts over resolved ones, field by field, where they are known."""
    s, r = supplied.alias("s"), resolved.alias("r")

    def value(f: str) -> Column:
        own = F.col(f"s.{f}")
        return F.coalesce(text.known(own) if dict(supplied.dtypes)[f] == "string" else own, F.col(f"r.{f}")).alias(f)

    return s.join(r, F.col(f"s.{key}") == F.col(f"r.{key}"), "full").select(F.coalesce(F.col(f"s.{key}"), F.col(f"r.{key}")).alias(key), *map(value, fields))


def route_overrides(routes: DataFrame, overrides: DataFrame) -> DataFrame:
    """First reviewed override whose road and box hold a route's centre.  routes: ``route_id, lat, lon, highway_ref``; overrides: ``position, id, highway_ref, min_lat ..`` (a short list)."""
    ref = lambda c: F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))
    o = overrides.select("position", "id", ref(F.col("highway_ref")).alias("__ref"), "min_lat", "max_lat", "min_lon", "max_lon")
    hit = routes.withColumn("__own", ref(F.col("highway_ref"))).join(o, (F.col("__own") == F.col("__ref")) & F.col("lat").between(F.col("min_lat"), F.col("max_lat")) & F.col("lon").between(F.col("min_lon"), F.col("max_lon")))
    best = hit.groupBy("route_id").agg(F.min(F.struct("position", "id")).alias("o"))
    return routes.join(best, "route_id", "left").select(*(routes[c] for c in routes.columns), F.col("o.id").alias("override_id"))


def route_centres(points: DataFrame) -> DataFrame:
    """Upper median of each axis.  points: ``route_id, lat, lon``."""
    return points.groupBy("route_id").agg(geo.upper_median("lat").alias("lat"), geo.upper_median("lon").alias("lon"))


def sample_trajectory(points: DataFrame, maximum: int, key: str = "route_id", order: str = "pos") -> DataFrame:
    """At most ``maximum`` points of each route, evenly spread, ends kept; positions are rounded half to even.

    points: ``route_id, pos, ..`` where ``pos`` counts a route's points from 0, so only the count a route is gathered.
    """
    sizes = points.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    step = F.transform(F.sequence(F.lit(0), F.lit(maximum - 1)), lambda i: F.bround(i * (F.col("n") - 1) / F.lit(maximum - 1)).cast("long"))
    wanted = sizes.select(key, F.explode(F.array_distinct(F.when(F.col("n") > maximum, step).otherwise(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))).alias(order))
    return points.join(wanted, [key, order])


def nearest_way(points: DataFrame, ways: DataFrame, cell_deg: float = 0.01, most_m: float | None = None) -> DataFrame:
    """``point_id, way_id, metres``: the nearest way of each point at whatever distance (or up to ``most_m``); of equal distances the least ``way_id``.

    points: ``point_id, lat, lon``; ways: ``way_id, geometry``.  A way goes as its segments, each at the level of a grid whose cells are as
    wide as the segment is long, so a long one is posted to a handful of cells and not to all that it crosses.

    Rings of fourfold width are searched around the points that are still open.  In a ring, boxes around the segments of a cell come first: a box whose
    nearest place is farther than the farthest place of another holds no answer, so a point far from a town meets the town's edge and not its streets.  A point is
    settled when its best segment is nearer than anything beyond the ring can be.  Points without a place, and all points where no way has a
    geometry, get nulls.

    A place is searched once, however many points stand there, and a segment goes once, under its least ``way_id``; so the search grows with
    places and segments that differ, and the points are joined with their places' answers at the end.
    """
    c = F.col
    two = F.transform(geo.segments(c("geometry")), lambda s: F.array(s["a"], s["b"]))
    parts = ways.select("way_id", F.explode(F.when(F.size("geometry") >= 2, two).otherwise(F.array("geometry"))).alias("pts")).where("get(pts, 0).lat is not null and get(pts, 0).lon is not null")
    parts = parts.groupBy("pts").agg(F.min("way_id").alias("way_id"))
    for axis in ("lat", "lon"):
        of = c(f"pts.{axis}")
        parts = parts.withColumn(f"{axis}0", F.array_min(of)).withColumn(f"{axis}1", F.array_max(of))
    extent = F.greatest(c("lat1") - c("lat0"), c("lon1") - c("lon0"))
    parts = cut(parts.withColumn("level", F.when(extent > cell_deg, F.ceil(F.log2(extent / cell_deg)).cast("int")).otherwise(0)))
    levels = sorted(r[0] for r in parts.select("level").distinct().collect())  # a degree of cells doubles fifteen times to the globe
    cell = lambda x, level: F.floor(x / (F.lit(cell_deg) * F.pow(F.lit(2.0), level))).cast("long")
    open_ = points.select("lat", "lon").where("lat is not null and lon is not null").distinct()
    open_ = open_.withColumn("b", F.lit(None).cast(f"struct<metres: double, way_id: {ways.schema['way_id'].dataType.simpleString()}>"))
    # rings narrower than the shortest segments' cells would look at the same cells
    found, ring, first = None, min(levels, default=0), True
    while levels:
        reach = cell_deg * 2**ring
        last = reach >= 360
        # the cells of coarser levels were looked at in the first ring
        own = levels if first else [k for k in levels if k <= ring]
        best = _in_ring(open_.drop("b"), parts if first else parts.where(c("level") <= ring), own, ring, cell).select("lat", "lon", F.struct("metres", "way_id").alias("n"))
        nearer = cut(open_.join(best, ["lat", "lon"], "left").withColumn("b", F.array_min(F.filter(F.array("b", "n"), lambda x: x.isNotNull()))).drop("n"))
        # anything that no probed cell holds differs by the ring's width in latitude or in longitude
        within = _beyond(c("lat"), F.lit(reach))
        done = F.coalesce((c("b.metres") <= within) | (within > (math.inf if most_m is None else most_m)), F.lit(False)) | F.lit(last)
        new = nearer.where(done & c("b").isNotNull()).select("lat", "lon", "b")
        found = new if found is None else found.unionByName(new)
        open_ = nearer.where(~done)
        if last or not open_.limit(1).count():
            break
        ring, first = ring + 2, False
    if found is None:
        return points.select("point_id").distinct().select("point_id", F.lit(None).cast(ways.schema["way_id"].dataType).alias("way_id"), F.lit(None).cast("double").alias("metres"))
    if most_m is not None:
        found = found.where(c("b.metres") <= most_m)
    one = points.select("point_id", "lat", "lon").join(found, ["lat", "lon"], "left").groupBy("point_id").agg(F.min("b").alias("b"))
    return one.select("point_id", c("b.way_id").alias("way_id"), c("b.metres").alias("metres"))


def _beyond(lat: Column, degrees: Column) -> Column:
    """No place that differs by so many degrees on an axis is nearer, on the sphere or on the plane at ``lat``."""
    return geo.EARTH_M * F.asin(F.cos(F.radians(lat)) * F.sin(F.radians(F.least(degrees, F.lit(90.0)))))


def _in_ring(open_: DataFrame, parts: DataFrame, levels: list[int], ring: int, cell: Callable[[Column, Column], Column]) -> DataFrame:
    """``lat, lon, way_id, metres``: each place's best segment among those of the nine cells around it at the ring's level and at each coarser level that has segments."""
    c = F.col
    # boxes are three levels finer than the ring, where the segments allow it
    fine = F.greatest(c("level"), F.lit(ring - 3))
    boxed = parts.withColumn("box", F.struct(fine.alias("f"), cell(c("lat0"), fine).alias("y"), cell(c("lon0"), fine).alias("x")))
    boxes = boxed.groupBy("box").agg(*(F.min(k).alias(k) for k in ("lat0", "lon0")), *(F.max(k).alias(k) for k in ("lat1", "lon1")))
    grid = F.greatest(c("box.f"), F.lit(ring))
    span = lambda axis: F.sequence(cell(c(f"{axis}0"), c("g")), cell(c(f"{axis}1"), c("g")))
    posted = boxes.withColumn("g", grid).withColumn("y", F.explode(span("lat"))).withColumn("x", F.explode(span("lon")))
    around = F.explode(F.array(*(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in (-1, 0, 1) for x in (-1, 0, 1))))
    probes = open_.withColumn("g", F.explode(F.array(*map(F.lit, sorted({max(k, ring) for k in levels}))))).withColumn("d", around)
    probes = probes.select("lat", "lon", "g", (cell(c("lat"), c("g")) + c("d.y")).alias("y"), (cell(c("lon"), c("g")) + c("d.x")).alias("x"))
    apart = lambda axis: F.greatest(F.lit(0.0), c(f"{axis}0") - c(axis), c(axis) - c(f"{axis}1"))
    across = lambda axis: F.greatest(F.abs(c(f"{axis}0") - c(axis)), F.abs(c(f"{axis}1") - c(axis)))
    metre = math.radians(1.0) * geo.EARTH_M
    nearest = F.greatest(apart("lat") * metre, _beyond(c("lat"), apart("lon")))
    met = probes.join(posted, ["g", "y", "x"]).select("lat", "lon", "box", nearest.alias("near"), ((across("lat") + across("lon")) * metre).alias("far")).distinct()
    sure = met.groupBy("lat", "lon").agg(F.min("far").alias("sure"))
    kept = met.join(sure, ["lat", "lon"]).where("near <= sure + 0.001").select("lat", "lon", "box")
    pairs = kept.join(boxed.select("box", "way_id", "pts"), "box")
    metres = F.round(geo.polyline_distance_m(c("lat"), c("lon"), c("pts")), 6)
    return pairs.groupBy("lat", "lon").agg(F.min(F.struct(metres.alias("metres"), "way_id")).alias("b")).select("lat", "lon", c("b.way_id").alias("way_id"), c("b.metres").alias("metres"))


def classify_route(points: DataFrame, ways: DataFrame) -> DataFrame:
    """Road class whose ways best cover a trajectory.

    points: ``route_id, pos, lat, lon`` (sampled: a dozen a route); ways: ``route_id, way_id, road_class, confidence, geometry, oneway``.
    Gives ``route_id, road_class, way_id, quality, confidence``.

    A route's points stay one array, which meets each of its ways once, so a way's distances are an array too; a way stands in a route once.  Both
    sides are joined as sorted partitions of routes: Spark guesses exploded points too low and would send them through the driver.
    """
    c = F.col
    routes = points.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))).alias("at"))
    a, z = F.get("at", F.lit(0)), F.get("at", F.size("at") - 1)
    routes = routes.select("route_id", "at", F.when(a["pos"] < z["pos"], geo.bearing(a["lat"], a["lon"], z["lat"], z["lon"])).alias("heading"))
    near = ways.hint("merge").join(routes.hint("merge"), "route_id")
    near = near.withColumn("ds", F.transform("at", lambda p: geo.polyline_distance_m(p["lat"], p["lon"], c("geometry"))))
    near = near.withColumn("fit", F.when(F.size("geometry") >= 2, F.greatest(F.lit(0.0), 1.0 - geo.undirected_difference(travel_bearing(c("geometry"), c("oneway")), c("heading")) / 90.0)))
    inner = lambda ds: F.array_sort(F.filter(ds, lambda d: d.isNotNull()))
    near = near.select("route_id", "road_class", "way_id", "confidence", "fit", "ds", inner(c("ds")).alias("own"))
    n = F.size("own")
    middle = F.when(n % 2 == 1, F.get("own", F.floor(n / 2).cast("int"))).otherwise(0.5 * F.get("own", F.floor(n / 2).cast("int") - 1) + 0.5 * F.get("own", F.floor(n / 2).cast("int")))
    by_class = near.groupBy("route_id", "road_class").agg(F.collect_list("ds").alias("all"), F.coalesce(F.max("fit"), F.lit(0.5)).alias("alignment"), F.max("confidence").alias("prior"), F.min(F.struct(middle.alias("m"), "way_id", "confidence")).alias("w"))
    # each point's nearest way of the class
    nearest = F.transform(F.get("all", F.lit(0)), lambda _, k: F.array_min(F.transform("all", lambda ds: F.get(ds, k))))
    scored = by_class.select("route_id", "road_class", "alignment", "prior", "w", inner(nearest).alias("ds"))
    coverage = F.size(F.filter("ds", lambda d: d <= 35.0)) / F.nullif(F.size("ds"), F.lit(0))
    mid = F.get("ds", F.floor(F.size("ds") / 2).cast("int"))
    quality = 0.65 * coverage + 0.25 * F.greatest(F.lit(0.0), 1.0 - mid / 60.0) + 0.10 * c("alignment")
    scored = scored.withColumn("quality", quality)
    best = scored.groupBy("route_id").agg(F.max(F.struct((F.col("quality") * (0.85 + 0.15 * F.col("prior"))).alias("s"), "road_class", "w", "quality")).alias("b"))
    return best.select("route_id", F.col("b.road_class").alias("road_class"), F.col("b.w.way_id").alias("way_id"), F.col("b.quality").alias("quality"), F.bround(F.least(F.lit(0.95), F.col("b.w.confidence") * (0.55 + 0.45 * F.col("b.quality"))), 3).alias("confidence"))


def vote_class(ways: DataFrame) -> DataFrame:
    """Class by summed confidence where no geometry is known."""
    # sums of fractions differ in their last digits by the order of rows; equal ones must tie
    sums = ways.groupBy("route_id", "road_class").agg(F.round(F.sum("confidence"), 6).alias("s"), F.count(F.lit(1)).alias("n"), F.max("confidence").alias("top"))
    total = F.sum("n").over(Window.partitionBy("route_id"))
    best = sums.withColumn("share", F.col("n") / total).groupBy("route_id").agg(F.max(F.struct("s", "road_class", "share", "top")).alias("b"))
    return best.select("route_id", F.col("b.road_class").alias("road_class"), F.bround(F.least(F.lit(0.90), F.col("b.top") * (0.60 + 0.30 * F.col("b.share"))), 3).alias("confidence"))


def is_oneway(tag: Column) -> Column:
    return F.coalesce(F.lower(tag).isin("yes", "1", "true", "-1"), F.lit(False))


def travel_bearing(geometry: Column, oneway: Column) -> Column:
    a, z = F.get(geometry, F.lit(0)), F.get(geometry, F.size(geometry) - 1)
    b = geo.bearing(a["lat"], a["lon"], z["lat"], z["lon"])
    return F.when(F.trim(F.coalesce(oneway, F.lit(""))) == "-1", F.pmod(b + 180.0, F.lit(360.0))).otherwise(b)


def opposite_carriageways(ways: DataFrame, most_m: float = 80.0) -> DataFrame:
    """``way_id, other_id, metres``: nearest one-way way of the same road that runs the other way close by.

    ways: ``way_id, highway, ref, name, oneway, geometry``.  Vertices of one place, road and course are one spot, which goes under its least ``way_id`` and is
    searched once, however many ways have it.  Spots are posted to grid cells and meet only those of their road in their own and the eight cells beside it: of a sixteenth of
    ``most_m`` first, then of fourfold width for spots that found nothing, so a dense road costs a few neighbours of each spot and not all within ``most_m``.
    Roads do not cross the antimeridian.
    """
    c = F.col
    squeezed = lambda n: F.lower(F.regexp_replace(F.trim(F.coalesce(c(n), F.lit(""))), r"\s+", "" if n == "ref" else " "))
    road = F.when(squeezed("ref") != "", F.concat(F.lit("r:"), squeezed("ref"))).when(squeezed("name") != "", F.concat(F.lit("n:"), squeezed("name")))
    one = ways.where(is_oneway(c("oneway")) & (F.size("geometry") >= 2)).select("way_id", F.coalesce("highway", F.lit("")).alias("highway"), road.alias("road"), travel_bearing(c("geometry"), c("oneway")).alias("b"), "geometry").where("road is not null and b is not null")
    # a way never meets its own course; one that is given with several courses keeps spots of its own, so that it isn't its own partner
    same = Window.partitionBy("way_id")
    own = F.when(F.min("b").over(same) < F.max("b").over(same), F.concat(F.lit("w:"), c("way_id").cast("string"))).otherwise("")
    key = ["highway", "road", "own", "b", "lat", "lon"]
    vertices = cut(one.withColumn("own", own)).select("way_id", "highway", "road", "own", "b", F.explode("geometry").alias("p")).select("way_id", "highway", "road", "own", "b", c("p.lat").alias("lat"), c("p.lon").alias("lon"))
    spots = cut(vertices.where("lat is not null and lon is not null").groupBy(key).agg(F.min("way_id").alias("other_id")))
    open_, found, reach = spots.select(key), None, most_m / 16
    while True:
        # nothing beyond the cells is as near as what is within reach
        searched = cut(open_.join(_opposite_within(open_, spots, key, reach), key, "left"))
        new = searched.where("n is not null")
        found, open_ = new if found is None else found.unionByName(new), searched.where("n is null").select(key)
        if reach >= most_m or not open_.limit(1).count():
            break
        reach = min(most_m, 4 * reach)
    best = vertices.join(found, key).groupBy("way_id").agg(F.min("n").alias("n"))
    return best.select("way_id", c("n.other_id").alias("other_id"), c("n.metres").alias("metres"))


def _opposite_within(open_: DataFrame, spots: DataFrame, key: list[str], reach: float) -> DataFrame:
    """``key, n``: the nearest spot (``metres, other_id``) of the same road that runs the other way, within ``reach`` metres."""
    c = F.col
    # cells are as wide as the distance on the ground at the vertex's own latitude, and a little more
    step = math.degrees(max(reach, 0.001) / geo.EARTH_M) * 1.01
    row = F.floor(c("lat") / step).cast("long")

    def column_at(y: Column) -> Column:
        # one width for a whole row of cells: the widest in it, at its edge away from the equator
        edge = F.greatest(F.abs(y * step), F.abs((y + 1) * step))
        return F.floor(c("lon") / (step / F.greatest(F.cos(F.radians(F.least(edge, F.lit(89.0)))), F.lit(0.01)))).cast("long")

    near = F.array(*(F.struct((c("y") + dy).alias("y"), (column_at(c("y") + dy) + dx).alias("x")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))
    left = open_.withColumn("y", row).withColumn("cell", F.explode(near)).drop("y")
    right = spots.withColumn("y", row).select("highway", "road", F.struct("y", column_at(c("y")).alias("x")).alias("cell"), "other_id", c("own").alias("own2"), c("b").alias("b2"), c("lat").alias("q_lat"), c("lon").alias("q_lon"))
    pairs = left.join(right, ["highway", "road", "cell"]).where((F.abs(c("lat") - c("q_lat")) <= step) & (geo.heading_difference(c("b2"), c("b")) >= 120.0) & ((c("own") == "") | (c("own") != c("own2"))))
    metres = F.round(geo.distance_m(c("lat"), c("lon"), c("q_lat"), c("q_lon")), 6)
    return pairs.withColumn("metres", metres).where(c("metres") <= reach).groupBy(key).agg(F.min(F.struct("metres", "other_id")).alias("n"))


def lane_context(ways: DataFrame, pairs: DataFrame) -> DataFrame:
    """Lanes and carriageways of each way: totals only for two-way ways and for pairs.  ways: ``way_id, lanes, oneway, dual_carriageway, divider``."""
    own = ways.select("way_id", text.lane_count(F.col("lanes")).alias("n"), is_oneway(F.col("oneway")).alias("one"), ((F.lower(F.coalesce("dual_carriageway", F.lit(""))) == "yes") | ~F.coalesce("divider", F.lit("")).isin("", "no")).alias("split"))
    other = own.select(F.col("way_id").alias("other_id"), F.col("n").alias("m"))
    j = own.join(pairs.select("way_id", "other_id"), "way_id", "left").join(other, "other_id", "left")
    paired = F.col("one") & F.col("other_id").isNotNull()
    n, m = F.col("n"), F.col("m")
    same = paired & (n == m)
    return j.select(
        "way_id",
        F.when(paired | F.col("split"), "divided").when(F.col("one"), "one_way").when(n.isNotNull(), "undivided").otherwise("unknown").alias("carriageway"),
        n.alias("osm_way_lanes"), F.when(paired, F.when(same, n)).when(F.col("one"), n).alias("lanes_per_carriageway"), F.when(paired, m).alias("opposite_lanes"),
        F.when(paired, n + m).when(~F.col("one"), n).alias("osm_total_lanes"), F.when(paired, 2).when(~F.col("one") & n.isNotNull(), 1).alias("carriageway_count"),
        F.when(same, n + m).when(~F.col("one"), n).alias("total_road_lanes"),
    )


def setting(highway: Column, lit: Column, sidewalk: Column, near_landuse: Column, near_place: Column) -> Column:
    """near_*: arrays of tag values of features nearby."""
    urban = highway.isin("residential", "living_street") | (F.coalesce(lit, F.lit("")) == "yes") | sidewalk.isNotNull()
    near = F.arrays_overlap(F.coalesce(near_landuse, F.array()), F.array(*map(F.lit, ("residential", "commercial", "retail", "industrial")))) | F.arrays_overlap(F.coalesce(near_place, F.array()), F.array(*map(F.lit, ("city", "town", "suburb", "neighbourhood"))))
    return F.when(F.coalesce(urban, F.lit(False)) | F.coalesce(near, F.lit(False)), "urban").when(highway.isin("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified"), "rural").otherwise("unknown")


ROADSIDE = ("chevron", "warning sign", "mandatory sign", "speed limit")


def sheet_facts(observations: DataFrame, route: str = "route_id") -> DataFrame:
    """``route_id, lanes, centre, shoulder, sign, speed`` of each row of a sheet; cells that say nothing are null."""
    have = observations.columns
    cell = lambda c: F.col(f"`{c}`").cast("string") if c in have else F.lit(None).cast("string")
    first = lambda c: F.get(text.numbers(cell(c)), F.lit(0))
    sign = F.nullif(F.trim(cell("Traffic Sign Class")), F.lit(""))
    lanes = first("Expected Total Lanes")
    return observations.select(F.col(route).alias("route_id"), F.when(lanes > 0, lanes).alias("lanes"), first("Centre Lanes Detected").alias("centre"), first("Shoulder Lanes Detected").alias("shoulder"), F.when(F.lower(sign) != "nan", sign).alias("sign"), text.sign_speed(sign).alias("speed"))


def from_sheet(observations: DataFrame, route: str = "route_id") -> DataFrame:
    """What a route's sheet says: lanes, carriageway, sign class and mounting, posted speed.

    A median of centre lines may be 0 (an unmarked centre), which tells divided roads; lane counts must be positive.
    """
    agg = sheet_facts(observations, route).groupBy("route_id").agg(
        *(geo.upper_median(c).alias(c) for c in ("lanes", "centre", "shoulder")), F.array_sort(F.collect_set("sign")).alias("signs"), geo.upper_median("speed").alias("speed"),
    )
    return summed_sheet(agg)


def summed_sheet(agg: DataFrame, *keep: str) -> DataFrame:
    """The context of routes from their upper medians ``lanes, centre, shoulder, speed`` and their ``signs``."""
    agg = agg.withColumns({c: F.col(c).cast("int") for c in ("lanes", "centre", "shoulder")})
    plain = lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))
    roadside = lambda s: any_of([plain(s).contains(t) for t in ROADSIDE])
    way = F.when(F.coalesce(F.col("lanes"), F.lit(0)) < 2, "unknown").when(F.col("centre") >= F.col("lanes") - 1, "undivided").when((F.col("centre") == 0) & (F.col("shoulder") >= 2), "divided").otherwise("unknown")
    return agg.select("route_id", "lanes", way.alias("carriageway"), F.when(F.size("signs") == 1, F.get("signs", F.lit(0))).alias("sign_class"), F.when((F.size("signs") > 0) & F.forall("signs", lambda s: roadside(s)), "shoulder").alias("sign_mounting"), F.col("speed").alias("posted_speed_kmph"), *keep)


def with_sheet(contexts: DataFrame, sheet: DataFrame) -> DataFrame:
    """Contexts (``route_id`` and the engine's context columns) with what their sheets add where they are silent.

    A sheet's lanes are the observed carriageway's on divided and one-way roads, and doubled only for a paired road whose other
    side has as many at least; elsewhere they are the road's total.  Such totals are provisional.
    """
    s = sheet.select(F.col("route_id").alias("__r"), *(F.col(c).alias(f"__{c}") for c in ("lanes", "carriageway", "sign_class", "sign_mounting", "posted_speed_kmph")))
    j = contexts.join(s, F.col("route_id").eqNullSafe(F.col("__r")), "left")
    c = F.col
    way = F.coalesce(text.known(c("carriageway")), text.known(c("__carriageway")), F.lit("unknown"))
    stated = F.coalesce(c("total_road_lanes"), c("lanes_total"))
    one_side = way.isin("divided", "one_way") & c("__lanes").isNotNull()
    doubled = one_side & (way == "divided") & stated.isNull() & (c("carriageway_count") == 2) & (c("osm_way_lanes") == c("__lanes")) & (c("opposite_carriageway_lanes") >= c("__lanes"))
    whole = ~way.isin("divided", "one_way") & c("__lanes").isNotNull() & stated.isNull()
    total = F.coalesce(stated, F.when(doubled, 2 * c("__lanes")).when(whole, c("__lanes")))
    inferred = F.coalesce((doubled | whole) & stated.isNull(), F.lit(False))
    new = {
        "carriageway": way, "total_road_lanes": total, "lanes_total": total, "lanes_per_carriageway": F.coalesce(c("lanes_per_carriageway"), F.when(one_side, c("__lanes"))),
        "carriageway_count": F.coalesce(c("carriageway_count"), F.when(whole & (way == "undivided"), 1)), "lanes_provisional": F.when(c("lanes_total").isNotNull(), False).when(inferred, True).otherwise(c("lanes_provisional")),
        "posted_speed_source": F.coalesce(c("posted_speed_source"), F.when(c("design_speed_kmph").isNull() & c("posted_speed_kmph").isNull() & c("__posted_speed_kmph").isNotNull(), "numbered speed-limit sign detected in input workbook")),
        "posted_speed_kmph": F.coalesce(c("posted_speed_kmph"), F.when(c("design_speed_kmph").isNull(), c("__posted_speed_kmph"))),
        "sign_class": F.coalesce(F.nullif(c("sign_class"), F.lit("")), c("__sign_class")), "sign_mounting": F.coalesce(text.known(c("sign_mounting")), c("__sign_mounting")),
    }
    return j.select(*(new[x].cast(t).alias(x) if x in new else c(x) for x, t in contexts.dtypes))


# Fixed value: ways that are no roads.
IGNORED_WAYS = ("footway", "path", "service", "steps", "pedestrian", "track", "cycleway")
CROSS_M = 150.0


def cross_points(points: DataFrame, most: int = 7) -> DataFrame:
    """``route_id, pos, side, lat, lon``: points 150 m left and right of a sampled trajectory, square to its course.

    points: ``route_id, pos, lat, lon`` where ``pos`` counts from 0; routes of one point have no course and give none.
    """
    ends = points.groupBy("route_id").agg(F.min(F.struct("pos", "lat", "lon")).alias("a"), F.max(F.struct("pos", "lat", "lon")).alias("z")).where("a.pos < z.pos")
    course = ends.select("route_id", geo.bearing(F.col("a.lat"), F.col("a.lon"), F.col("z.lat"), F.col("z.lon")).alias("course"))
    own = sample_trajectory(points, most).join(course, "route_id").withColumn("side", F.explode(F.array(F.lit(-90.0), F.lit(90.0))))
    at = geo.destination(F.col("lat"), F.col("lon"), F.col("course") + F.col("side"), F.lit(CROSS_M))
    return own.select("route_id", "pos", "side", at["lat"].alias("lat"), at["lon"].alias("lon"))


def infer_terrain(heights: DataFrame) -> DataFrame:
    """``route_id, cross_slope, terrain`` from the heights of :func:`cross_points` (adds ``elevation``)."""
    left, right = (F.max(F.when(F.col("side") == x, F.col("elevation"))) for x in (-90.0, 90.0))
    slopes = heights.groupBy("route_id", "pos").agg((F.abs(left - right) / (2 * CROSS_M) * 100.0).alias("slope")).where("slope is not null")
    mid = slopes.groupBy("route_id").agg(geo.upper_median("slope").alias("cross_slope"))
    return mid.withColumn("terrain", geo.terrain(F.col("cross_slope")))


def resolve_routes(points: DataFrame, features: DataFrame, heights: DataFrame | None = None) -> DataFrame:
    """Context of each route from map features near it: class, setting, lanes, speeds, terrain.

    points: ``route_id, pos, lat, lon`` (sampled to a dozen a route); features: ``route_id, way_id, tags, geometry``, those
    found near a route.  A class is chosen by coverage of the trajectory, or by votes where no way has a geometry.
    """
    c = F.col
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    kind = text.road_class(tag("ref"), tag("highway"))
    ways = features.where(tag("highway").isNotNull() & ~tag("highway").isin(*IGNORED_WAYS)).select("route_id", "way_id", "tags", "geometry", kind["road_class"].alias("road_class"), kind["confidence"].alias("confidence"), tag("oneway").alias("oneway")).where("road_class is not null")
    shaped = ways.where(F.size("geometry") > 0)
    matched = classify_route(points, shaped)
    best_vote = vote_class(ways).join(matched.select("route_id"), "route_id", "left_anti")
    first = ways.join(best_vote.withColumnRenamed("confidence", "v"), ["route_id", "road_class"]).groupBy("route_id", "road_class", "v").agg(F.max(F.struct("confidence", "way_id")).alias("w"))
    chosen = matched.select("route_id", "road_class", "way_id", "confidence", "quality").unionByName(first.select("route_id", "road_class", c("w.way_id").alias("way_id"), c("v").alias("confidence"), F.lit(None).cast("double").alias("quality")))
    own = ways.join(chosen.select("route_id", "road_class"), ["route_id", "road_class"])
    speed = text.speed_kmph(tag("maxspeed"))
    refs = own.where(tag("ref").isNotNull()).groupBy("route_id", tag("ref").alias("ref")).agg(F.count(F.lit(1)).alias("n")).groupBy("route_id").agg(F.max(F.struct("n", "ref")).alias("r")).select("route_id", c("r.ref").alias("highway_ref"))
    speeds = own.groupBy("route_id").agg(F.max(speed).alias("posted_speed_kmph"), F.array_sort(F.collect_set(speed)).alias("osm_maxspeed_values_kmph"))
    nearby = features.groupBy("route_id").agg(F.collect_set(tag("landuse")).alias("landuse"), F.collect_set(tag("place")).alias("place"))
    flat = own.select("way_id", tag("highway").alias("highway"), tag("ref").alias("ref"), tag("name").alias("name"), "oneway", "geometry", tag("lanes").alias("lanes"), tag("dual_carriageway").alias("dual_carriageway"), tag("divider").alias("divider")).dropDuplicates(["way_id"])
    lanes = lane_context(flat, opposite_carriageways(flat))
    rep = chosen.join(ways.select("route_id", "way_id", "tags"), ["route_id", "way_id"]).join(nearby, "route_id").withColumn("setting", setting(tag("highway"), tag("lit"), tag("sidewalk"), c("landuse"), c("place"))).drop("landuse", "place", "tags")
    out = rep.join(lanes, "way_id", "left").join(refs, "route_id", "left").join(speeds, "route_id", "left").withColumnRenamed("opposite_lanes", "opposite_carriageway_lanes")
    out = out.withColumn("posted_speed_source", F.when(c("posted_speed_kmph").isNotNull(), "OpenStreetMap maxspeed tag")).withColumn("road_class_confidence", c("confidence")).drop("confidence")
    ground = infer_terrain(heights).select("route_id", "terrain") if heights is not None else points.select("route_id").distinct().withColumn("terrain", F.lit("unknown"))
    return points.select("route_id").distinct().join(out, "route_id", "left").join(ground, "route_id", "left").withColumn("terrain", F.coalesce("terrain", F.lit("unknown")))


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)
