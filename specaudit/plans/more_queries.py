"""Further named queries with DuckDB SQL: evidence, rules, road context, scoring and formats, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specaudit.functions import geo, text
from specaudit.operators import audit, context, corpus, evaluation, retrieval, rules
from specaudit.plans import catalog
from specaudit.plans import fixtures as fx
from specaudit.plans.queries import hits, query

# --- evidence ------------------------------------------------------------------------------------------------------

_HITS = "h AS (SELECT 'r' || (corpus_idx % 7) AS request_id, corpus_idx, (corpus_idx * 7919 % 10007)::double / 10007 AS score, corpus_idx % 4 = 0 AS structured FROM chunk_v)"


@query(f"""WITH {fx.CHUNKS}, {_HITS}, s AS (SELECT *, CASE WHEN structured THEN (corpus_idx * 31 % 997)::double / 997 END AS rel, CASE WHEN NOT structured THEN score END AS own FROM h),
w AS (SELECT *, min(rel) OVER p AS lo, max(rel) OVER p AS hi, coalesce(min(own) OVER p, 0) AS flo, coalesce(max(own) OVER p, 1.0::double / 61) AS fhi FROM s WINDOW p AS (PARTITION BY request_id))
SELECT request_id, corpus_idx, round(CASE WHEN structured THEN flo + CASE WHEN hi > lo THEN (rel - lo) / (hi - lo) ELSE 0.5::double END * (fhi - flo) ELSE own END, 9) AS score FROM w""")
def structured_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir).withColumn("structured", F.col("corpus_idx") % 4 == 0)
    x = h.select("request_id", "corpus_idx", "structured", F.when(F.col("structured"), (F.col("corpus_idx") * 31 % 997) / F.lit(997.0)).alias("relevance"), F.when(~F.col("structured"), F.col("score")).alias("score"))
    return retrieval.structured_scores(x).select("request_id", "corpus_idx", F.round("score", 9).alias("score"))


@query(f"""WITH {fx.CHUNKS}, r AS (SELECT source AS request_id, corpus_idx, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, row_number() OVER (PARTITION BY source ORDER BY corpus_idx) AS n FROM chunk_v WHERE corpus_idx % 3 <> 0)
SELECT request_id, n::int AS n, 'E' || corpus_idx AS evidence_id, substr(t, 1, 320) AS quote FROM r WHERE n <= 3""")
def alternative_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source asks for other passages than those divisible by three."""
    c = fx.chunks(spark, sf_dir)
    name = F.concat(F.lit("E"), F.col("corpus_idx").cast("string"))
    h = c.select(F.col("source").alias("request_id"), F.col("corpus_idx").alias("rank"), name.alias("evidence_id"), F.when(F.col("corpus_idx") % 3 == 0, name).otherwise("none").alias("cited"), "standard_id", "edition_year", "source", "page", "text")
    return rules.alternatives(h, 3, "cited").select("request_id", F.explode("alternatives").alias("a")).select("request_id", F.col("a.__n").alias("n"), "a.evidence_id", "a.quote")


@query(f"""WITH {fx.CHUNKS}, k AS (SELECT *, row_number() OVER (PARTITION BY standard_id ORDER BY corpus_idx) AS rank FROM chunk_v),
g AS (SELECT corpus_idx AS case_id, standard_id, CASE WHEN corpus_idx % 5 = 0 THEN 'E' || corpus_idx END AS ev, CASE WHEN corpus_idx % 5 = 1 THEN content_hash END AS ch, CASE WHEN corpus_idx % 5 = 2 THEN 'THE w beam rail stands at ' || (700 + corpus_idx % 60) || ' +/- ' || (5 + corpus_idx % 30) || ' mm' END AS q, CASE WHEN corpus_idx % 2 = 0 THEN edition_year END AS y FROM chunk_v)
SELECT g.case_id, min(k.rank) AS first_rank FROM g LEFT JOIN k ON k.standard_id = g.standard_id AND k.rank <= 40 AND coalesce(ev, ch, q) IS NOT NULL AND (ev IS NULL OR ev = 'E' || k.corpus_idx) AND (ch IS NULL OR ch = k.content_hash)
 AND (q IS NULL OR contains(lower(regexp_replace(k.text, '\\s+', ' ', 'g')), lower(q))) AND (y IS NULL OR y = k.edition_year) GROUP BY 1""")
def first_matching_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases look for their passage by id, digest or quote among the first forty hits of its standard."""
    c, n = fx.chunks(spark, sf_dir), F.col("corpus_idx")
    name = F.concat(F.lit("E"), n.cast("string"))
    # ids are ranked, and only the forty's texts are fetched
    best = c.select("standard_id", "corpus_idx").withColumn("rank", F.row_number().over(Window.partitionBy("standard_id").orderBy("corpus_idx"))).where("rank <= 40")
    k = c.join(F.broadcast(best), ["standard_id", "corpus_idx"]).withColumn("evidence_id", name)
    quote = F.concat(F.lit("THE  w beam rail stands at "), (700 + n % 60).cast("string"), F.lit(" +/- "), (5 + n % 30).cast("string"), F.lit(" mm"))
    gold = c.select(
        n.alias("case_id"), F.col("standard_id").alias("request_id"), F.when(n % 5 == 0, name).alias("expected_evidence_id"), F.when(n % 5 == 1, F.col("content_hash")).alias("expected_content_hash"), F.when(n % 5 == 2, quote).alias("expected_quote"),
        F.when(n % 2 == 0, F.col("edition_year")).alias("expected_edition_year"), F.lit(None).cast("long").alias("expected_page"), F.lower("standard_id").alias("expected_standard_id"),
    )
    return evaluation.first_matches(gold, k.withColumn("request_id", F.col("standard_id"))).select("case_id", F.col("first_rank").cast("long").alias("first_rank"))


@query("""SELECT doc_id AS case_id FROM labels WHERE quality = 1 AND (doc_id % 3 = 0 OR doc_id % 5 = 0 OR doc_id % 7 = 0)""")
def invalid_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, n = fx.load(spark, sf_dir, "labels"), F.col("doc_id")
    none = F.lit(None).cast("string")
    g = x.select(n.alias("case_id"), F.when(F.col("quality") == 1, "found").otherwise("not_found").alias("expected_status"), F.when(n % 3 != 0, "quote").alias("expected_quote"), none.alias("expected_evidence_id"), none.alias("expected_content_hash"), F.when(n % 5 != 0, 3.5).alias("expected_value_m"), F.when(n % 7 != 0, ">=").alias("expected_comparator"))
    return evaluation.validate_gold(g).select("case_id")


# --- rules ---------------------------------------------------------------------------------------------------------

TERRAINS = ("plain", "rolling", "mountainous", "steep", "unknown")


@query("""SELECT doc_id AS request_id, CASE WHEN doc_id % 5 < 2 THEN 200 + doc_id % 300 ELSE 50 + doc_id % 90 END::double AS raw_value, 'm' AS raw_unit, '>=' AS comparator, true AS direct_table FROM documents WHERE doc_id % 5 < 4""")
def radius_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of curve radii behind each text; each request's terrain picks its row."""
    d, n = fx.load(spark, sf_dir, "documents"), F.col("doc_id")
    num = lambda c: c.cast("string")
    table = F.concat(F.lit("Minimum radii of horizontal curves\nDesirable minimum radius | absolute  minimum radius\nPlain and rolling "), num(200 + n % 300), F.lit(" m "), num(100 + n % 99), F.lit(" m Mountainous and steep "), num(50 + n % 90), F.lit(" metres 30 metres"))
    h = d.select(n.alias("request_id"), F.lit("min_radius_curvature").alias("metric_key"), F.lit(1).alias("rank"), F.lit("e").alias("evidence_id"), table.alias("text"))
    c = d.select(n.alias("request_id"), F.get(F.array(*map(F.lit, TERRAINS)), (n % 5).cast("int")).alias("terrain"))
    return rules.extract_radius(h, c).select("request_id", "raw_value", "raw_unit", "comparator", "direct_table")


@query(f"""WITH {fx.CHUNKS} SELECT corpus_idx AS request_id, ((700 + corpus_idx % 60) - (5 + corpus_idx % 30))::double AS raw_value, ((700 + corpus_idx % 60) + (5 + corpus_idx % 30))::double AS second_raw_value, 'mm' AS raw_unit, 'range' AS comparator FROM chunk_v WHERE corpus_idx % 5 = 2""")
def w_beam_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = fx.chunks(spark, sf_dir).select(F.col("corpus_idx").alias("request_id"), F.lit("min_w_beam_barrier_height").alias("metric_key"), F.lit(1).alias("rank"), F.lit("e").alias("evidence_id"), "text")
    return rules.extract_tolerances(h).select("request_id", "raw_value", "second_raw_value", "raw_unit", "comparator")


_BASES = ("verified_design_speed", "osm_posted_speed_proxy", "detected_posted_speed_proxy", "unknown")


@query("""WITH c AS (SELECT c_custkey AS n, c_custkey % 2 = 0 AS radius, c_custkey % 5 = 0 AS direct, ['verified_design_speed', 'osm_posted_speed_proxy', 'detected_posted_speed_proxy', 'unknown'][c_custkey % 4 + 1] AS b, (20 + c_custkey % 100) AS v, c_custkey % 7 = 0 AS prov, (c_custkey % 100)::double / 100 AS q, CASE WHEN c_custkey % 3 = 0 THEN 'known basis' END AS was FROM customer),
p AS (SELECT *, NOT direct AND b IN ('osm_posted_speed_proxy', 'detected_posted_speed_proxy') AS proxy, CASE WHEN direct THEN 'table of terrain and carriageway' WHEN b = 'verified_design_speed' THEN 'design speed, verified: ' || v || ' km/h' WHEN b = 'osm_posted_speed_proxy' THEN 'posted speed of the map: ' || (v + 1) || ' km/h' WHEN b = 'detected_posted_speed_proxy' THEN 'posted speed of a sign seen: ' || (v + 1) || ' km/h' END AS says FROM c)
SELECT n, CASE WHEN radius AND says IS NOT NULL THEN concat_ws('; ', says, was) ELSE was END AS basis, prov OR (radius AND proxy) AS provisional, least(q, CASE WHEN NOT radius OR NOT proxy THEN 1.0 WHEN b = 'osm_posted_speed_proxy' THEN 0.78 ELSE 0.74 END)::double AS quality FROM p""")
def radius_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    x = fx.load(spark, sf_dir, "customer").select(
        n.alias("n"), F.when(n % 2 == 0, "min_radius_curvature").otherwise("min_lane_width").alias("metric_key"), F.lit(100.0).alias("value_m"), (n % 5 == 0).alias("direct_table"), F.get(F.array(*map(F.lit, _BASES)), (n % 4).cast("int")).alias("speed_basis"),
        (20 + n % 100).cast("double").alias("design_speed_kmph"), (21 + n % 100).cast("double").alias("posted_speed_kmph"), (n % 7 == 0).alias("provisional"), ((n % 100) / F.lit(100.0)).alias("quality"), F.when(n % 3 == 0, "known basis").alias("basis"),
    )
    return rules.radius_basis(x).select("n", "basis", "provisional", "quality")


@query("""WITH c AS (SELECT c_custkey AS n, c_custkey % 4 = 0 AS verified, c_custkey % 3 > 0 AS paged, 100 + c_custkey % 900 AS mm, c_custkey % 11 = 0 AS misquoted FROM customer),
v AS (SELECT *, mm / 1000.0::double AS m, CASE WHEN misquoted THEN 'e' WHEN mm < 50 OR mm > 600 THEN 'absurd' END AS bad, verified AND paged AS clean FROM c)
SELECT n, CASE WHEN bad IS NOT NULL THEN 'invalid_evidence' WHEN clean THEN 'found' ELSE 'ambiguous' END AS status, CASE WHEN bad IS NULL THEN m END AS value_m,
 CASE WHEN bad = 'e' THEN 'value_not_in_quote: the quote does not hold the number with its unit' WHEN bad = 'absurd' THEN regexp_replace(printf('%g', m), '\\.?0+$', '') || ' m lies outside 0.05 to 0.6 m, where such a value must lie'
  ELSE concat_ws('; ', 'stated in the cited passage', CASE WHEN NOT paged THEN 'no page is cited' END, CASE WHEN NOT verified THEN 'unverified source' END) END AS reason FROM v""")
def validated_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kerb heights of all sizes; some are misquoted, some have no page, and only some sources are verified."""
    n = F.col("c_custkey")
    said = F.concat(F.lit("The kerb height shall be "), (100 + n % 900).cast("string"), F.lit(" mm on rural roads"))
    none = F.lit(None)
    m = catalog.METRICS["min_kerb_height"]
    x = fx.load(spark, sf_dir, "customer").select(
        n.alias("n"), F.lit("min_kerb_height").alias("metric_key"), F.lit("kerb height").alias("metric_name"), said.alias("hit_text"), said.alias("text"), said.alias("quote"), F.when(n % 11 == 0, 7.0).otherwise(100.0 + n % 900).alias("raw_value"), none.cast("double").alias("second_raw_value"), F.lit("mm").alias("raw_unit"), F.lit("=").alias("comparator"),
        none.cast("string").alias("applies_to"), F.array().cast("array<string>").alias("conditions"), F.lit("setting: rural").alias("context_text"), F.when(n % 3 > 0, 4).alias("page"), F.lit("IRC:86").alias("standard_id"), F.lit(2018).alias("edition_year"), F.lit("a.pdf").alias("source"), F.lit("sha").alias("sha"), F.lit(1).alias("rank"),
        F.array(*map(F.lit, m.preferred)).alias("preferred"), F.array(F.lit(2018)).alias("editions"), (n % 4 == 0).alias("verified"), F.lit(2018).alias("active_edition_year"), F.array(F.lit("a.pdf")).alias("approved_sources"), F.array(F.lit("sha")).alias("approved_sha256"),
        F.lit("undivided").alias("carriageway"), F.lit(2).alias("total_road_lanes"), F.lit("State Highway").alias("road_class"), F.lit("rural").alias("setting"), F.lit(False).alias("lanes_provisional"), F.lit(m.low_m).alias("low_m"), F.lit(m.high_m).alias("high_m"), none.cast("string").alias("rationale"),
    )
    return rules.validate(x).select("n", "status", "value_m", "reason")


@query("""SELECT s_suppkey, s_suppkey % 3 > 0 AND s_suppkey % 4 > 0 AND s_suppkey % 5 > 0 AND s_suppkey % 7 > 1 AS verified FROM supplier""")
def policy_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey")
    some = lambda m, v: F.when(n % m > 0, F.array(F.lit(v))).otherwise(F.array().cast("array<string>"))
    x = fx.load(spark, sf_dir, "supplier").select("s_suppkey", F.when(n % 3 > 0, 2018).alias("active_edition_year"), some(4, "a.pdf").alias("approved_sources"), some(5, "sha").alias("approved_sha256"), F.lit("https://x").alias("official_source_url"), F.lit("fair use").alias("licence_basis"), F.when(n % 7 == 1, "unknown").when(n % 7 == 0, " ").otherwise("me").alias("reviewed_by"), F.lit("2024-01-01").alias("reviewed_on"))
    return x.select("s_suppkey", corpus.policy_verified().alias("verified"))


# --- road context --------------------------------------------------------------------------------------------------


@query("""WITH w AS (SELECT c_nationkey AS route_id, ['Expressway', 'National Highway', 'State Highway'][c_custkey % 3 + 1] AS road_class, (1 + c_custkey % 4) * 0.25::double AS confidence FROM customer),
s AS (SELECT route_id, road_class, sum(confidence) AS s, count(*) AS n, max(confidence) AS top FROM w GROUP BY ALL), t AS (SELECT *, n::double / sum(n) OVER (PARTITION BY route_id) AS share FROM s)
SELECT route_id, road_class, round_even(least(0.90::double, top * (0.60::double + 0.30::double * share)), 3) AS confidence FROM t QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY s DESC, road_class DESC) = 1""")
def road_class_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    w = fx.load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("route_id"), F.get(F.array(*map(F.lit, ("Expressway", "National Highway", "State Highway"))), (n % 3).cast("int")).alias("road_class"), ((1 + n % 4) * F.lit(0.25)).alias("confidence"))
    return context.vote_class(w)


@query("""WITH o AS (SELECT c_custkey AS way_id, CASE WHEN c_custkey % 7 > 0 THEN (c_custkey % 7)::int END AS n, c_custkey % 3 > 0 AS one, c_custkey % 10 = 0 OR c_custkey % 13 = 0 AS split, CASE WHEN c_custkey % 4 = 0 THEN c_custkey + 7 * (c_custkey % 2) + 1 END AS other FROM customer),
j AS (SELECT a.*, b.n AS m, a.one AND a.other IS NOT NULL AS paired FROM o a LEFT JOIN o b ON b.way_id = a.other), s AS (SELECT *, coalesce(paired AND n = m, false) AS same FROM j)
SELECT way_id, CASE WHEN paired OR split THEN 'divided' WHEN one THEN 'one_way' WHEN n IS NOT NULL THEN 'undivided' ELSE 'unknown' END AS carriageway, n AS osm_way_lanes, CASE WHEN paired THEN CASE WHEN same THEN n END WHEN one THEN n END AS lanes_per_carriageway, CASE WHEN paired THEN m END AS opposite_lanes,
 CASE WHEN paired THEN n + m WHEN NOT one THEN n END AS osm_total_lanes, CASE WHEN paired THEN 2 WHEN NOT one AND n IS NOT NULL THEN 1 END AS carriageway_count, CASE WHEN same THEN n + m WHEN NOT one THEN n END AS total_road_lanes FROM s""")
def lanes_of_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = fx.load(spark, sf_dir, "customer"), F.col("c_custkey")
    w = c.select(n.alias("way_id"), F.when(n % 7 > 0, (n % 7).cast("string")).otherwise("many").alias("lanes"), F.when(n % 3 == 0, "no").when(n % 3 == 1, "Yes").otherwise("-1").alias("oneway"), F.when(n % 10 == 0, "yes").alias("dual_carriageway"), F.when(n % 13 == 0, "kerb").otherwise("no").alias("divider"))
    pairs = c.where(n % 4 == 0).select(n.alias("way_id"), (n + 7 * (n % 2) + 1).alias("other_id"))
    return context.lane_context(w, pairs)


_P = "p AS (SELECT user_id AS route_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, 17 + (event_id % 100) * 0.001::double AS lat, 78 + (event_id * 7 % 100) * 0.001::double AS lon FROM events)"


@query(f"""WITH {_P}, n AS (SELECT route_id, count(*) AS n, arg_min(lat, pos) AS alat, arg_min(lon, pos) AS alon, arg_max(lat, pos) AS zlat, arg_max(lon, pos) AS zlon FROM p GROUP BY 1 HAVING count(*) > 1),
c AS (SELECT *, ((degrees(atan2(sin(radians(zlon - alon)) * cos(radians(zlat)), cos(radians(alat)) * sin(radians(zlat)) - sin(radians(alat)) * cos(radians(zlat)) * cos(radians(zlon - alon)))) + 360) % 360 + 360) % 360 AS course FROM n),
w AS (SELECT DISTINCT route_id, course, CASE WHEN n > 7 THEN round_even(k * (n - 1)::double / 6, 0)::bigint ELSE k END AS pos FROM c, range(7) t(k) WHERE n > 7 OR k < n),
s AS (SELECT w.route_id, w.pos, side, radians(course + side) AS h, radians(lat) AS a, lon, 150.0::double / 6371000 AS d FROM w JOIN p USING (route_id, pos), (VALUES (-90.0::double), (90.0::double)) t(side)),
t AS (SELECT *, asin(sin(a) * cos(d) + cos(a) * sin(d) * cos(h)) AS phi FROM s)
SELECT route_id, pos, side, round(degrees(phi), 6) AS lat, round(degrees(radians(lon) + atan2(sin(h) * sin(d) * cos(a), cos(d) - sin(a) * sin(phi))), 6) AS lon FROM t""")
def cross_section_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = fx.load(spark, sf_dir, "events"), F.col("event_id")
    p = e.select(F.col("user_id").alias("route_id"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("pos"), (17 + (n % 100) * F.lit(0.001)).alias("lat"), (78 + (n * 7 % 100) * F.lit(0.001)).alias("lon"))
    return context.cross_points(p).select("route_id", "pos", "side", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("""WITH s AS (SELECT user_id AS route_id, abs((event_id % 90) - (event_id * 3 % 50))::double / 300 * 100 AS slope FROM events WHERE event_id % 9 > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY slope) AS rn, count(*) OVER (PARTITION BY route_id) AS n FROM s)
SELECT route_id, round(slope, 6) AS cross_slope, CASE WHEN slope < 10 THEN 'plain' WHEN slope < 25 THEN 'rolling' WHEN slope < 40 THEN 'mountainous' ELSE 'steep' END AS terrain FROM r WHERE rn = n // 2 + 1""")
def terrain_of_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = fx.load(spark, sf_dir, "events"), F.col("event_id")
    sides = e.select(F.col("user_id").alias("route_id"), n.alias("pos"), F.explode(F.array(F.lit(-90.0), F.lit(90.0))).alias("side"))
    h = sides.withColumn("elevation", F.when(F.col("side") < 0, (F.col("pos") % 90).cast("double")).when(F.col("pos") % 9 > 0, (F.col("pos") * 3 % 50).cast("double")))
    return context.infer_terrain(h).withColumn("cross_slope", F.round("cross_slope", 6))


@query("""WITH r AS (SELECT user_id AS route_id, 17 + (event_id % 100) * 0.001::double AS lat, 78 + (event_id * 7 % 100) * 0.001::double AS lon FROM events),
a AS (SELECT route_id, lat, row_number() OVER (PARTITION BY route_id ORDER BY lat) AS rn, count(*) OVER (PARTITION BY route_id) AS n FROM r), b AS (SELECT route_id, lon, row_number() OVER (PARTITION BY route_id ORDER BY lon) AS rn, count(*) OVER (PARTITION BY route_id) AS n FROM r)
SELECT a.route_id, lat, lon FROM a JOIN b ON a.route_id = b.route_id AND a.rn = a.n // 2 + 1 AND b.rn = b.n // 2 + 1""")
def route_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = fx.load(spark, sf_dir, "events"), F.col("event_id")
    return context.route_centres(e.select(F.col("user_id").alias("route_id"), (17 + (n % 100) * F.lit(0.001)).alias("lat"), (78 + (n * 7 % 100) * F.lit(0.001)).alias("lon")))


@query("""WITH f AS (SELECT c_custkey AS n, ['residential', 'trunk', 'track', 'secondary'][c_custkey % 4 + 1] AS hw, c_custkey % 9 = 0 AS lit, c_custkey % 14 = 0 AS walk, c_custkey % 10 = 0 AS land, c_custkey % 15 = 0 AS place FROM customer)
SELECT n, CASE WHEN hw = 'residential' OR lit OR walk OR land OR place THEN 'urban' WHEN hw IN ('trunk', 'secondary') THEN 'rural' ELSE 'unknown' END AS setting FROM f""")
def urban_setting(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    near = lambda m, v: F.when(n % m == 0, F.array(F.lit("meadow"), F.lit(v))).when(n % 2 == 0, F.array(F.lit("meadow")))
    way = context.setting(F.get(F.array(*map(F.lit, ("residential", "trunk", "track", "secondary"))), (n % 4).cast("int")), F.when(n % 9 == 0, "yes").otherwise("no"), F.when(n % 14 == 0, "both"), near(10, "retail"), near(15, "town"))
    return fx.load(spark, sf_dir, "customer").select(n.alias("n"), way.alias("setting"))


@query("""SELECT c_custkey AS n, concat_ws('; ', 'jurisdiction: India', CASE WHEN c_custkey % 3 > 0 THEN 'road class: ' || c_mktsegment END, CASE WHEN c_custkey % 5 = 0 THEN 'setting: rural' END, CASE WHEN c_custkey % 4 > 0 THEN 'base through-lane total: ' || (c_custkey % 4) END, CASE WHEN c_custkey % 6 = 0 THEN 'lane configuration status: provisional' END,
 CASE WHEN c_custkey % 7 > 0 THEN 'posted speed: ' || regexp_replace(printf('%.1f', (c_custkey % 7) * 12.5::double), '\\.0$', '') || ' km/h (' || CASE WHEN c_custkey % 2 = 0 THEN 'OSM tag' ELSE 'unverified source' END || ')' END,
 CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'radius speed basis: osm_posted_speed_proxy' ELSE 'radius speed basis: detected_posted_speed_proxy' END) AS line FROM customer""")
def rendered_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    c = fx.load(spark, sf_dir, "customer").select(n.alias("n"), F.when(n % 3 > 0, F.col("c_mktsegment")).otherwise("unknown").alias("road_class"), F.when(n % 5 == 0, "rural").alias("setting"), F.when(n % 4 > 0, n % 4).alias("total_road_lanes"), (n % 6 == 0).alias("lanes_provisional"), F.when(n % 7 > 0, (n % 7) * F.lit(12.5)).alias("posted_speed_kmph"), F.when(n % 2 == 0, "OSM tag").alias("posted_speed_source"))
    return c.select("n", context.render(c).alias("line"))


_BEARS = "((degrees(atan2(sin(radians(blon - alon)) * cos(radians(blat)), cos(radians(alat)) * sin(radians(blat)) - sin(radians(alat)) * cos(radians(blat)) * cos(radians(blon - alon)))) + CASE WHEN back THEN 180 ELSE 0 END) % 360 + 360) % 360"


@query(f"""WITH e AS (SELECT event_id, event_id % 4 IN (0, 1, 2) AS oneway, event_id % 4 = 2 AS back, 17.0::double AS alat, 78.0::double AS alon, 17 + (event_id % 19 - 9) * 0.01::double AS blat, 78 + (event_id % 23 - 11) * 0.01::double AS blon FROM events)
SELECT event_id, oneway, CASE WHEN blat = alat AND blon = alon THEN NULL ELSE round({_BEARS}, 6) % 360 END AS bearing FROM e""")
def travel_bearings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    tag = F.when(n % 4 == 0, " YES".strip()).when(n % 4 == 1, "1").when(n % 4 == 2, "-1").otherwise("no")
    at = lambda lat, lon: F.struct(lat.alias("lat"), lon.alias("lon"))
    z = at(17 + (n % 19 - 9) * F.lit(0.01), 78 + (n % 23 - 11) * F.lit(0.01))
    line = F.array(at(F.lit(17.0), F.lit(78.0)), at(F.lit(17.5), F.lit(78.5)), z)
    still = (n % 19 == 9) & (n % 23 == 11)
    return fx.load(spark, sf_dir, "events").select("event_id", context.is_oneway(tag).alias("oneway"), F.when(~still, F.round(context.travel_bearing(line, tag), 6) % 360).alias("bearing"))


_CLASSES = ("Expressway", "National Highway", "State Highway")


@query(f"""WITH p AS (SELECT c_custkey AS route_id, k AS pos, 17 + (c_custkey % 50) * 0.01::double + k * 0.001::double AS lat, 78 + (c_custkey % 7) * 0.0001::double * k AS lon FROM customer, range(7) t(k)),
w AS (SELECT c_custkey AS route_id, k AS way_id, ['Expressway', 'National Highway', 'State Highway'][k % 3 + 1] AS road_class, 0.5::double + k * 0.05::double AS confidence, 17 + (c_custkey % 50) * 0.01::double AS alat, 78 + ((c_custkey * (k + 3)) % 11) * 0.0001::double AS alon,
 17 + (c_custkey % 50) * 0.01::double + 0.006::double AS blat, 78 + ((c_custkey * (k + 5)) % 13) * 0.0003::double AS blon, (c_custkey + k) % 3 = 0 AS back FROM customer, range(5) t(k)),
x AS (SELECT p.route_id, pos, way_id, road_class, confidence, (alon - lon) * cos(radians(lat)) * radians(1) * 6371000 AS ax, (alat - lat) * radians(1) * 6371000 AS ay, (blon - lon) * cos(radians(lat)) * radians(1) * 6371000 AS bx, (blat - lat) * radians(1) * 6371000 AS by_ FROM p JOIN w USING (route_id)),
t AS (SELECT *, greatest(0, least(1, -(ax * (bx - ax) + ay * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))) AS s FROM x), d AS (SELECT *, sqrt(pow(ax + s * (bx - ax), 2) + pow(ay + s * (by_ - ay), 2)) AS d FROM t),
c AS (SELECT route_id, road_class, pos, min(d) AS d FROM d GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY route_id, road_class ORDER BY d) AS rn, count(*) OVER (PARTITION BY route_id, road_class) AS n FROM c),
a AS (SELECT route_id, road_class, avg((d <= 35)::int) AS coverage, max(d) FILTER (rn = n // 2 + 1) AS mid FROM r GROUP BY ALL),
h AS (SELECT route_id, arg_min(lat, pos) AS alat, arg_min(lon, pos) AS alon, arg_max(lat, pos) AS blat, arg_max(lon, pos) AS blon, false AS back FROM p GROUP BY 1), b AS (SELECT route_id, {_BEARS} AS heading FROM h), v AS (SELECT *, {_BEARS} AS bearing FROM w),
f AS (SELECT v.route_id, road_class, confidence, abs(((bearing - heading + 180) % 360 + 360) % 360 - 180) AS diff FROM v JOIN b USING (route_id)),
g AS (SELECT route_id, road_class, max(greatest(0, 1 - least(diff, 180 - diff) / 90)) AS fit, max(confidence) AS prior FROM f GROUP BY ALL),
m AS (SELECT route_id, road_class, way_id, confidence, median(d) AS m FROM d GROUP BY ALL), n AS (SELECT route_id, road_class, arg_min(confidence, struct_pack(m := m, w := way_id)) AS confidence, arg_min(way_id, struct_pack(m := m, w := way_id)) AS way_id FROM m GROUP BY ALL),
q AS (SELECT a.route_id, a.road_class, n.way_id, n.confidence, prior, 0.65::double * coverage + 0.25::double * greatest(0, 1 - mid / 60) + 0.10::double * fit AS quality FROM a JOIN g USING (route_id, road_class) JOIN n USING (route_id, road_class))
SELECT route_id, road_class, way_id, round(quality, 6) AS quality, round_even(least(0.95::double, confidence * (0.55::double + 0.45::double * quality)), 3) AS confidence FROM q QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY quality * (0.85::double + 0.15::double * prior) DESC, road_class DESC) = 1""")
def road_class_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer drives a route of seven points beside five ways."""
    c, n = fx.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("route_id")), F.col("route_id")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    k = F.col("k")
    p = c.withColumn("k", each(7)).select("route_id", k.alias("pos"), (17 + (n % 50) * F.lit(0.01) + k * F.lit(0.001)).alias("lat"), (78 + (n % 7) * F.lit(0.0001) * k).alias("lon"))
    at = lambda lat, lon: F.struct(lat.alias("lat"), lon.alias("lon"))
    a = at(17 + (n % 50) * F.lit(0.01), 78 + ((n * (k + 3)) % 11) * F.lit(0.0001))
    z = at(17 + (n % 50) * F.lit(0.01) + F.lit(0.006), 78 + ((n * (k + 5)) % 13) * F.lit(0.0003))
    w = c.withColumn("k", each(5)).select("route_id", k.alias("way_id"), F.get(F.array(*map(F.lit, _CLASSES)), k % 3).alias("road_class"), (F.lit(0.5) + k * F.lit(0.05)).alias("confidence"), F.array(a, z).alias("geometry"), F.when((n + k) % 3 == 0, "-1").alias("oneway"))
    return context.classify_route(p, w).select("route_id", "road_class", "way_id", F.round("quality", 6).alias("quality"), "confidence")


@query("""WITH c AS (SELECT c_custkey AS n, c_custkey % 5 > 0 AS seen, CASE c_custkey % 4 WHEN 0 THEN 'divided' WHEN 1 THEN 'undivided' WHEN 2 THEN 'one_way' ELSE 'unknown' END AS way, CASE WHEN c_custkey % 7 = 0 THEN 6 END AS total, CASE WHEN c_custkey % 3 = 0 THEN 2 END AS cc, 2 AS osm, 1 + c_custkey % 3 AS opp FROM customer),
s AS (SELECT *, CASE WHEN seen THEN 2 + n % 2 END AS lanes, CASE WHEN seen THEN 'undivided' END AS sway FROM c),
w AS (SELECT *, coalesce(nullif(way, 'unknown'), sway, 'unknown') AS ww FROM s), d AS (SELECT *, ww IN ('divided', 'one_way') AND lanes IS NOT NULL AS one FROM w),
e AS (SELECT *, coalesce(one AND ww = 'divided' AND total IS NULL AND cc = 2 AND osm = lanes AND opp >= lanes, false) AS doubled, ww NOT IN ('divided', 'one_way') AND lanes IS NOT NULL AND total IS NULL AS whole FROM d)
SELECT n, ww AS carriageway, coalesce(total, CASE WHEN doubled THEN 2 * lanes WHEN whole THEN lanes END)::int AS total_road_lanes, CASE WHEN one THEN lanes END::int AS lanes_per_carriageway, coalesce(cc, CASE WHEN whole AND ww = 'undivided' THEN 1 END)::int AS carriageway_count, CASE WHEN doubled OR whole THEN true END AS lanes_provisional,
 CASE WHEN seen THEN 60.0 END::double AS posted_speed_kmph FROM e""")
def context_with_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    c = fx.load(spark, sf_dir, "customer").select(
        n.alias("route_id"), F.when(n % 4 == 0, "divided").when(n % 4 == 1, "undivided").when(n % 4 == 2, "one_way").otherwise("unknown").alias("carriageway"), F.when(n % 7 == 0, 6).alias("total_road_lanes"), F.lit(None).cast("int").alias("lanes_total"), F.lit(None).cast("int").alias("lanes_per_carriageway"), F.when(n % 3 == 0, 2).alias("carriageway_count"),
        F.lit(2).alias("osm_way_lanes"), (1 + n % 3).cast("int").alias("opposite_carriageway_lanes"), F.lit(None).cast("boolean").alias("lanes_provisional"), F.lit(None).cast("double").alias("design_speed_kmph"), F.lit(None).cast("double").alias("posted_speed_kmph"), F.lit(None).cast("string").alias("posted_speed_source"), F.lit("").alias("sign_class"), F.lit("unknown").alias("sign_mounting"),
    )
    sheet = c.where(F.col("route_id") % 5 > 0).select("route_id", (2 + F.col("route_id") % 2).cast("int").alias("lanes"), F.lit("undivided").alias("carriageway"), F.lit("Chevron").alias("sign_class"), F.lit("shoulder").alias("sign_mounting"), F.lit(60.0).alias("posted_speed_kmph"))
    return context.with_sheet(c, sheet).select(F.col("route_id").alias("n"), "carriageway", "total_road_lanes", "lanes_per_carriageway", "carriageway_count", "lanes_provisional", "posted_speed_kmph")


# --- corpus and formats --------------------------------------------------------------------------------------------


@query(r"""WITH p AS (SELECT source AS source_path, length(regexp_replace(coalesce(text, ''), '\s+', '', 'g')) < 80 AS weak FROM documents) SELECT source_path, round(avg(weak::int), 9) AS weak_share, avg(weak::int) > 0.25 AS ocr FROM p GROUP BY 1""")
def pages_for_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.load(spark, sf_dir, "documents").select(F.col("source").alias("source_path"), "text")
    return corpus.needs_ocr(d).withColumn("weak_share", F.round("weak_share", 9))


@query("""WITH p AS (SELECT conv_id AS source_path, turn AS page, coalesce(text, '') AS text FROM conversations WHERE turn <= 4) SELECT source_path, string_agg(text, chr(10) ORDER BY page, text) AS cover FROM p GROUP BY 1""")
def cover_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.covers(fx.load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source_path"), F.col("turn").alias("page"), F.coalesce("text", F.lit("")).alias("text")))


@query(r"""WITH l AS (SELECT doc_id, string_split(concat('intro' || chr(10), CASE doc_id % 3 WHEN 0 THEN '## Title ' || doc_id WHEN 1 THEN 'Section 4.' || doc_id || ' Kerbs' ELSE 'plain' END, chr(10), coalesce(text, '')), chr(10)) AS ls FROM documents)
SELECT doc_id, list_filter(list_transform(ls, lambda x: struct_pack(t := trim(x, ' #' || chr(9)), h := starts_with(ltrim(x), '#'))), lambda s: s.t <> '' AND length(s.t) <= 160 AND (s.h OR regexp_matches(s.t, '(?i)^(?:section\s+)?\d+(?:\.\d+){0,4}\s+[A-Za-z]')))[1].t AS section FROM l""")
def section_of_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    own = F.concat(F.lit("intro\n"), F.when(n % 3 == 0, F.concat(F.lit("## Title "), n.cast("string"))).when(n % 3 == 1, F.concat(F.lit("Section 4."), n.cast("string"), F.lit(" Kerbs"))).otherwise("plain"), F.lit("\n"), F.coalesce("text", F.lit("")))
    return fx.load(spark, sf_dir, "documents").select("doc_id", text.section(own).alias("section"))


@query(r"""WITH v AS (SELECT l_orderkey, l_linenumber, sqrt(l_extendedprice::double) * [0.0000001, 0.00001, 0.001, 1, 1000, 10000000][l_linenumber % 6 + 1]::double AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, printf('%g', x) AS g, 'S' || (l_orderkey % 9) || ', p. ' || l_linenumber || CASE WHEN l_orderkey % 2 = 0 THEN ', 4 <Kerbs>' ELSE '' END AS label, replace(replace(CASE WHEN l_orderkey % 2 = 0 THEN '4 <Kerbs>' ELSE 'a & "b"' END, '&', '&amp;'), '<', '&lt;').replace('>', '&gt;').replace('"', '&quot;') AS html FROM v""")
def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of very different sizes, citations and escaped text."""
    n, k = F.col("l_orderkey"), F.col("l_linenumber")
    scale = F.get(F.array(*map(F.lit, (1e-7, 1e-5, 1e-3, 1.0, 1e3, 1e7))), (k % 6).cast("int"))
    sect = F.when(n % 2 == 0, "4 <Kerbs>")
    label = text.citation_label(F.concat(F.lit("S"), (n % 9).cast("string")), F.lit("file"), k, sect)
    return fx.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.fmt_g(F.sqrt(F.col("l_extendedprice").cast("double")) * scale).alias("g"), label.alias("label"), text.escape_html(F.coalesce(sect, F.lit('a & "b"'))).alias("html"))


@query("""WITH e AS (SELECT event_id, (event_id * 37 % 360)::double AS a, (event_id * 91 % 360)::double AS b FROM events), d AS (SELECT *, abs(((a - b + 180) % 360 + 360) % 360 - 180) AS h FROM e) SELECT event_id, h AS heading, least(h, 180 - h) AS undirected FROM d""")
def heading_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    a, b = (n * 37 % 360).cast("double"), (n * 91 % 360).cast("double")
    return fx.load(spark, sf_dir, "events").select("event_id", geo.heading_difference(a, b).alias("heading"), geo.undirected_difference(a, b).alias("undirected"))


_PREFERRED_BY = ", ".join(f"('{k}', '{p}')" for k, m in catalog.METRICS.items() for p in m.preferred)


@query(f"""WITH m AS (SELECT * FROM (VALUES {_PREFERRED_BY}) t(key, p)), v AS (SELECT upper(['irc:86', 'IRC:SP:84 - 2019', 'IRC:99', 'IRC:119'][s_suppkey % 4 + 1]) AS s FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 4 < 2)
SELECT DISTINCT key FROM m WHERE key NOT IN (SELECT key FROM m JOIN v ON starts_with(v.s, upper(m.p)))""")
def metrics_without_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey")
    name = F.get(F.array(*map(F.lit, ("irc:86", "IRC:SP:84 - 2019", "IRC:99", "IRC:119"))), (n % 4).cast("int"))
    good = (n % 3 == 0) & (n % 4 < 2)
    x = fx.load(spark, sf_dir, "supplier").select(name.alias("standard_id"), F.when(good, 2018).alias("active_edition_year"), F.array(F.lit("a.pdf")).alias("approved_sources"), F.array(F.lit("sha")).alias("approved_sha256"), *(F.lit("known").alias(c) for c in ("official_source_url", "licence_basis", "reviewed_by", "reviewed_on")))
    return corpus.uncovered_metrics(catalog.table(spark), x)


@query("""WITH r AS (SELECT DISTINCT user_id::varchar AS route_id FROM events), m AS (SELECT unnest(['min_lane_width', 'min_kerb_height', 'min_sign_height']) AS metric_key), k AS (SELECT DISTINCT user_id::varchar AS route_id, 'min_lane_width' AS metric_key, 'found' AS status, (user_id % 9)::double AS value_m FROM events WHERE user_id % 2 = 0)
SELECT r.route_id, m.metric_key, coalesce(k.status, 'not_applicable') AS status, k.value_m FROM r, m LEFT JOIN k ON k.route_id = r.route_id AND k.metric_key = m.metric_key""")
def rules_of_every_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.load(spark, sf_dir, "events").select("user_id", F.col("user_id").cast("string").alias("route_id"))
    known = e.where("user_id % 2 = 0").distinct().select("route_id", F.lit("min_lane_width").alias("metric_key"), F.lit("found").alias("status"), (F.col("user_id") % 9).cast("double").alias("value_m"))
    return audit.complete_rules(known, e, ("min_lane_width", "min_kerb_height", "min_sign_height")).select("route_id", "metric_key", "status", "value_m")


@query("""SELECT doc_id, doc_id % 3 = 0 AND doc_id % 2 = 0 AS approved FROM documents""")
def approved_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    names, digests = F.when(n % 3 == 0, F.array(F.lit("x"), F.col("source"))).when(n % 3 == 1, F.array(F.lit("x"))), F.when(n % 2 == 0, F.array(F.lit("sha"))).otherwise(F.array(F.lit(None).cast("string")))
    return fx.load(spark, sf_dir, "documents").select("doc_id", corpus.source_approved(F.col("source"), F.lit("sha"), names, digests).alias("approved"))


@query("""WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Code IRC:SP:' || (doc_id % 120 + 1) || ' of ' || (1960 + doc_id % 60) WHEN 2 THEN 'Code 1RC:' || (doc_id % 120 + 1) || '-' || (1960 + doc_id % 60) ELSE 'no title' END AS cover FROM documents)
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'IRC:SP:' || (doc_id % 120 + 1) WHEN 1 THEN 'IRC:' || (doc_id % 99 + 1) WHEN 2 THEN 'IRC:' || (doc_id % 120 + 1) WHEN 3 THEN 'IRC:SP:' || (doc_id % 99 + 1) END AS standard_id, CASE WHEN doc_id % 5 < 4 THEN 1960 + doc_id % 60 END AS edition_year FROM d""")
def strict_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    num = lambda c: c.cast("string")
    year = num(1960 + n % 60)
    cover = F.when(n % 5 == 0, F.concat(F.lit("Code IRC:SP:"), num(n % 120 + 1), F.lit(" of "), year)).when(n % 5 == 2, F.concat(F.lit("Code 1RC:"), num(n % 120 + 1), F.lit("-"), year)).otherwise("no title")
    name = F.when(n % 5 == 1, F.concat(F.lit("IRC "), num(n % 99 + 1), F.lit("-"), year, F.lit(".pdf"))).when(n % 5 == 3, F.concat(F.lit("lRC SP "), num(n % 99 + 1), F.lit(" ("), year, F.lit(").pdf"))).otherwise("scan.pdf")
    d = fx.load(spark, sf_dir, "documents").select("doc_id", n.alias("source_path"), name.alias("source"), cover.alias("cover"))
    return corpus.strict_identity(d).select("doc_id", "standard_id", F.col("edition_year").cast("long").alias("edition_year"))


# --- operators without a query of their own so far -----------------------------------------------------------------


@query("""WITH c AS (SELECT doc_id AS chunk_id, doc_id // 3 AS doc, CASE WHEN doc_id // 3 % 4 = 0 THEN 'A' WHEN doc_id % 2 = 0 THEN 'B' END AS s, CASE WHEN doc_id % 7 > 0 THEN 1990 + doc_id // 3 % 5 END AS y FROM documents),
o AS (SELECT doc, CASE WHEN count(DISTINCT s) = 1 THEN min(s) END AS s1, CASE WHEN count(DISTINCT y) = 1 THEN min(y) END AS y1 FROM c GROUP BY 1),
n AS (SELECT doc, coalesce(CASE WHEN doc % 3 = 1 THEN 'A' END, s1) AS ns, coalesce(CASE WHEN doc % 3 = 2 THEN 2000 END, y1) AS ny FROM o)
SELECT count(*) AS passages, count(DISTINCT doc) AS documents, count(*) FILTER (s IS DISTINCT FROM ns) AS standards, count(*) FILTER (y IS DISTINCT FROM ny) AS editions FROM c JOIN n USING (doc) WHERE s IS DISTINCT FROM ns OR y IS DISTINCT FROM ny""")
def repair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, doc, d = F.col("doc_id"), F.expr("doc_id div 3"), F.col("document_sha256")
    chunks = fx.load(spark, sf_dir, "documents").select(n.alias("chunk_id"), doc.alias("document_sha256"), F.when(doc % 4 == 0, "A").when(n % 2 == 0, "B").alias("standard_id"), F.when(n % 7 > 0, 1990 + doc % 5).alias("edition_year"))
    new = chunks.select("document_sha256").distinct().select("document_sha256", F.when(d % 3 == 1, "A").alias("standard_id"), F.when(d % 3 == 2, F.lit(2000).cast("long")).alias("edition_year"))
    return corpus.repair_counts(chunks, new)


@query("""WITH e AS (SELECT user_id AS route, event_id AS way, event_id % 5 = 4 AS path, CASE event_id % 3 WHEN 0 THEN 'NH ' || (event_id % 4) WHEN 1 THEN 'SH ' || (user_id % 2) END AS ref, CASE WHEN event_id % 4 > 0 THEN (event_id % 6 + 3) * 10 END AS speed FROM events),
w AS (SELECT *, CASE WHEN ref LIKE 'NH%' THEN 'National Highway' WHEN ref LIKE 'SH%' THEN 'State Highway' ELSE 'Local Street' END AS class, CASE WHEN ref LIKE 'NH%' THEN 0.92::double WHEN ref LIKE 'SH%' THEN 0.90::double ELSE 0.60::double END AS c FROM e WHERE NOT path),
v AS (SELECT route, class, round(sum(c), 6) AS s, count(*) AS n, max(c) AS top FROM w GROUP BY ALL),
b AS (SELECT route, arg_max(class, struct_pack(s := s, k := class)) AS class FROM v GROUP BY 1),
t AS (SELECT route, sum(n) AS n FROM v GROUP BY 1),
f AS (SELECT b.route, b.class, round_even(least(0.90::double, v.top * (0.60::double + 0.30::double * v.n / t.n)), 3) AS conf FROM b JOIN v ON v.route = b.route AND v.class = b.class JOIN t ON t.route = b.route),
r AS (SELECT route, class, ref, count(*) AS n FROM w WHERE ref IS NOT NULL GROUP BY ALL),
m AS (SELECT f.route, arg_max(r.ref, struct_pack(n := r.n, x := r.ref)) AS ref FROM f JOIN r ON r.route = f.route AND r.class = f.class GROUP BY 1),
s AS (SELECT f.route, max(speed)::double AS posted, array_to_string(list_sort(list(DISTINCT speed) FILTER (speed IS NOT NULL)), ',') AS speeds FROM f JOIN w ON w.route = f.route AND w.class = f.class GROUP BY 1)
SELECT e.route AS route_id, f.class AS road_class, f.conf AS confidence, m.ref AS highway_ref, s.posted AS posted_speed_kmph, coalesce(s.speeds, '') AS speeds, CASE WHEN s.posted IS NOT NULL THEN 'tag' END AS basis
FROM (SELECT DISTINCT route FROM e) e LEFT JOIN f ON f.route = e.route LEFT JOIN m ON m.route = e.route LEFT JOIN s ON s.route = e.route""")
def resolved_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a user are the ways near a route, a fifth of them paths; without geometries classes are voted for."""
    n, u = F.col("event_id"), F.col("user_id")
    e = fx.load(spark, sf_dir, "events")
    ref = F.when(n % 3 == 0, F.concat(F.lit("NH "), (n % 4).cast("string"))).when(n % 3 == 1, F.concat(F.lit("SH "), (u % 2).cast("string")))
    tags = {"highway": F.when(n % 5 == 4, "footway").when(n % 3 == 2, "residential").otherwise("trunk"), "ref": ref, "maxspeed": F.when(n % 4 > 0, ((n % 6 + 3) * 10).cast("string"))}
    full = F.create_map(*(x for k, v in tags.items() for x in (F.lit(k), v)))
    features = e.select(u.alias("route_id"), n.alias("way_id"), F.map_filter(full, lambda k, v: v.isNotNull()).alias("tags"), F.array().cast("array<struct<lat:double,lon:double>>").alias("geometry"))
    points = e.select(u.alias("route_id")).distinct().select("route_id", F.lit(0).alias("pos"), F.lit(17.0).alias("lat"), F.lit(78.0).alias("lon"))
    out = context.resolve_routes(points, features)
    speeds = F.array_join(F.transform(F.coalesce("osm_maxspeed_values_kmph", F.array().cast("array<double>")), lambda x: x.cast("int").cast("string")), ",")
    return out.select("route_id", "road_class", F.col("road_class_confidence").alias("confidence"), "highway_ref", "posted_speed_kmph", speeds.alias("speeds"), F.when(F.col("posted_speed_source").isNotNull(), "tag").alias("basis"))


_STATUS = "['needs_context', 'not_found', 'ambiguous', 'invalid_evidence', 'found', 'not_applicable', NULL]"


@query(f"WITH s AS (SELECT doc_id, {_STATUS}[doc_id % 7 + 1] AS status FROM labels) SELECT doc_id AS case_id, coalesce(status IN ('needs_context', 'not_found', 'ambiguous', 'invalid_evidence'), false) AS abstains FROM s")
def abstentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(x) for x in ("needs_context", "not_found", "ambiguous", "invalid_evidence", "found", "not_applicable", None)))
    x = fx.load(spark, sf_dir, "labels")
    return x.select(F.col("doc_id").alias("case_id"), evaluation.abstains(F.get(names, (F.col("doc_id") % 7).cast("int"))).alias("abstains"))
