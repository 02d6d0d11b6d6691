"""Named queries over whole tables, each with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specaudit.functions import geo, text
from specaudit.operators import ann, audit, chunking, context, corpus, evaluation, inverted, retrieval, rules
from specaudit.plans import catalog
from specaudit.plans import fixtures as fx
from specaudit.sources import versions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


# --- audit ---------------------------------------------------------------------------------------------------------


def audited_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observation cells with their rule, state counts and severity; a broadcast join and projections only."""
    names = ("status", "value_m", "second_value_m", "comparator", "provisional", "basis", "label", "reason")
    r = fx.rules(spark).select("metric_key", F.struct(*names).alias("rule"))
    o = fx.observations(spark, sf_dir).withColumn("vals", text.numbers(F.col("cell"))).join(F.broadcast(r), "metric_key")  # six rows
    states = F.transform("vals", lambda v: audit.value_state(v, F.col("rule")))
    count = lambda s: F.size(F.filter("states", lambda x: x == s)).cast("long")
    return o.withColumn("states", states).withColumn("failures", count("FAIL")).withColumn("reviews", count("REVIEW_REQUIRED")).withColumn("severity", audit.severity(F.col("failures"), F.col("reviews")))


_COORD = "CASE WHEN try_cast(regexp_extract({label}, 'N: (\\d+\\.\\d+)', 1) AS double) <= 90 THEN try_cast(regexp_extract({label}, 'N: (\\d+\\.\\d+)', 1) AS double) END AS lat, CASE WHEN try_cast(regexp_extract({label}, 'N: (\\d+\\.\\d+)', 1) AS double) <= 90 THEN try_cast(regexp_extract({label}, 'E: (\\d+)\\. (\\d+)', 1) || '.' || regexp_extract({label}, 'E: (\\d+)\\. (\\d+)', 2) AS double) END AS lon"
_SEVERITY = "CASE WHEN failures >= 3 THEN 'HIGH SEVERITY (DANGEROUS)' WHEN failures = 2 THEN 'MEDIUM SEVERITY' WHEN failures = 1 THEN 'LOW SEVERITY' WHEN reviews > 0 THEN 'REVIEW REQUIRED' ELSE 'SAFE' END"


@query(f"WITH {fx.STATES} SELECT {_SEVERITY} AS severity, count(*) AS n FROM row_v WHERE label <> 'no fix' AND try_cast(regexp_extract(label, 'N: (\\d+\\.\\d+)', 1) AS double) <= 90 GROUP BY 1")
def audit_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = audited_cells(spark, sf_dir).withColumn("at", text.coordinates(F.col("label"))).where("at is not null")
    return own.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {fx.STATES} SELECT event_id, metric_key, CASE WHEN n = 0 THEN 'ABSENT' WHEN failures > 0 THEN 'FAIL' WHEN reviews > 0 THEN 'REVIEW_REQUIRED' ELSE 'PASS' END AS state, failures, reviews FROM row_v")
def audit_row_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = audited_cells(spark, sf_dir)
    return c.select("event_id", "metric_key", audit.cell(F.col("vals"), F.col("rule"), "Value")["state"].alias("state"), "failures", "reviews")


@query(f"""WITH {fx.STATES}, d AS (SELECT CASE WHEN failures > 0 THEN 'FAIL' WHEN reviews > 0 THEN 'REVIEW_REQUIRED' ELSE 'PASS' END AS disposition, count(*) AS n FROM row_v GROUP BY 1)
SELECT disposition, n, round_even(n * 100.0::double / sum(n) OVER (), 1) AS percent FROM d""")
def audit_disposition_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.disposition_share(audited_cells(spark, sf_dir))


@query(f"WITH {fx.STATES} SELECT metric_key FROM row_v GROUP BY 1 HAVING max(n) > 0")
def observed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.observed_metrics(sheets(spark, sf_dir), "w_beam")


@query(f"WITH {fx.STATES} SELECT metric_key, bool_or(n > 0) AS observed, sum(n)::bigint AS measured, sum(failures)::bigint AS failures FROM row_v GROUP BY 1")
def measured_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size("vals")
    return audited_cells(spark, sf_dir).groupBy("metric_key").agg(F.bool_or(n > 0).alias("observed"), F.sum(n).alias("measured"), F.sum("failures").alias("failures"))


@query(f"WITH {fx.STATES} SELECT route_id, sum(failures)::bigint AS failures, sum(reviews)::bigint AS reviews, max(failures) AS worst, count(*) AS n_rows FROM row_v GROUP BY 1")
def audit_by_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited_cells(spark, sf_dir).groupBy("route_id").agg(F.sum("failures").alias("failures"), F.sum("reviews").alias("reviews"), F.max("failures").alias("worst"), F.count(F.lit(1)).alias("n_rows"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_linenumber % 5 AS expected, (l_quantity::bigint % 4) AS c, CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE l_partkey % 3 END AS s FROM lineitem),
m AS (SELECT *, greatest(expected - 1 - c, 0) AS mc, greatest(2 - s, 0) AS ms FROM l)
SELECT l_orderkey, l_linenumber, CASE WHEN expected = 0 THEN 'REVIEW REQUIRED: expected lane count unavailable' WHEN s IS NULL THEN 'REVIEW REQUIRED: detected lane-marking counts unavailable'
 WHEN mc = 0 AND ms = 0 THEN 'Intact' ELSE concat_ws(' | ', CASE WHEN mc > 0 THEN mc || ' centre line(s) missing' END, CASE WHEN ms > 0 THEN ms || ' shoulder line(s) missing' END) END AS integrity FROM m""")
def lane_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = fx.load(spark, sf_dir, "lineitem")
    shoulder = F.when(F.col("l_suppkey") % 6 != 0, F.concat(F.lit("seen "), (F.col("l_partkey") % 3).cast("string")))
    centre = F.concat((F.col("l_quantity").cast("long") % 4).cast("string"), F.lit(" lines"))
    return x.select("l_orderkey", "l_linenumber", audit.lane_integrity((F.col("l_linenumber") % 5).cast("int"), centre, shoulder).alias("integrity"))


_3 = "regexp_replace(regexp_replace(printf('%.3f', {x}), '0+$', ''), '\\.$', '')"


@query(f"""WITH v AS (SELECT event_id, (event_id % 700) * 0.01::double + 0.005::double AS x FROM events)
SELECT event_id, CASE WHEN x < 3.5 THEN 'Lane: widen by ' || {_3.format(x="3.5::double - x")} || ' m (' || {_3.format(x="x")} || ' m measured, >= 3.5 m required).' ELSE '' END AS advice FROM v""")
def corrective_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("event_id") % 700) * F.lit(0.01) + F.lit(0.005)
    rule = F.from_json(F.lit('{"status":"found","value_m":3.5,"comparator":">="}'), audit.RULE)
    judged = fx.load(spark, sf_dir, "events").select("event_id", rule.alias("rule"), F.array(x).alias("v")).withColumn("each", audit.judged(F.col("v"), F.col("rule")))
    return judged.select("event_id", audit.corrective_action("min_lane_width", F.col("each"), F.col("rule"), "Lane").alias("advice"))


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as observation sheets of routes; a row fills one metric's column."""
    o = fx.observations(spark, sf_dir)
    pick = lambda k: F.when(F.col("metric_key") == k, F.col("cell"))
    return o.select(F.col("route_id").cast("string").alias("route_id"), F.col("event_id").cast("string").alias("Timestamp (sec)"), F.col("label").alias("Raw OCR Text"), F.lit("2").alias("Expected Total Lanes"), (F.col("event_id") % 3).cast("string").alias("Centre Lanes Detected"), F.lit("2").alias("Shoulder Lanes Detected"), *(pick(key).alias(column) for column, key, _, _ in audit.CHECKS))


_LABELS = "CASE metric_key " + " ".join(f"WHEN '{key}' THEN '{label}'" for _, key, _, label in audit.CHECKS) + " END"
_SHOWN = "CASE WHEN metric_key {test} AND n > 0 THEN shown ELSE 'Absent' END"


@query(f"""WITH {fx.OBSERVATIONS}, {fx.RULES_SQL}, {fx.VALUES}, w AS (SELECT v.*, {_LABELS} AS name, len(vals) AS n FROM val_v v),
x AS (SELECT w.event_id, w.metric_key, w.n, r.status, r.comparator, r.value_m AS a, r.second_value_m AS b, u.x, u.k, CASE WHEN w.n > 1 THEN name || ' ' || u.k ELSE name END AS subject FROM w JOIN rule_v r USING (metric_key), (SELECT unnest(w.vals) AS x, generate_subscripts(w.vals, 1) AS k) u),
j AS (SELECT *, CASE WHEN status <> 'found' THEN 'REVIEW_REQUIRED' WHEN CASE comparator WHEN '>=' THEN x >= a WHEN '<=' THEN x <= a WHEN '=' THEN abs(x - a) <= 1e-6 ELSE x BETWEEN a AND b END THEN 'PASS' WHEN comparator = '=' THEN 'REVIEW_REQUIRED' ELSE 'FAIL' END AS state FROM x),
d AS (SELECT *, subject || ': ' || printf('%g', x) || 'm ' || CASE WHEN status <> 'found' THEN '(candidate ' || comparator || ' ' || printf('%g', a) || 'm; ' || upper(replace(status, '_', ' ')) || ') - REVIEW REQUIRED'
   WHEN comparator = 'range' THEN '(between ' || printf('%g', a) || 'm and ' || printf('%g', b) || 'm) - ' || state
   ELSE '(' || CASE WHEN state = 'PASS' THEN comparator ELSE CASE comparator WHEN '>=' THEN '<' WHEN '<=' THEN '>' ELSE '!=' END END || ' ' || printf('%g', a) || 'm) - ' || state END AS said,
  subject || ': ' || CASE WHEN comparator <> '<=' AND x < a THEN CASE metric_key WHEN 'min_lane_width' THEN 'widen' ELSE 'raise' END || ' by ' || {_3.format(x="a - x")} ELSE 'lower by ' || {_3.format(x="x - CASE WHEN comparator = 'range' THEN b ELSE a END")} END
   || ' m (' || {_3.format(x="x")} || ' m measured, ' || CASE WHEN comparator = 'range' THEN {_3.format(x="a")} || ' to ' || {_3.format(x="b")} ELSE comparator || ' ' || {_3.format(x="a")} END || ' m required).' AS advice FROM j),
c AS (SELECT event_id, string_agg(said, ' | ' ORDER BY k) AS shown, CASE WHEN bool_or(state = 'FAIL') THEN 'FAIL' WHEN bool_or(state = 'REVIEW_REQUIRED') THEN 'REVIEW_REQUIRED' ELSE 'PASS' END AS state, string_agg(advice, ' ' ORDER BY k) FILTER (state = 'FAIL') AS advice FROM d GROUP BY 1),
r AS (SELECT w.*, c.shown, c.advice, coalesce(c.state, 'ABSENT') AS state, event_id % 3 = 0 AS broken FROM w LEFT JOIN c USING (event_id)),
t AS (SELECT *, (state = 'FAIL')::int + broken::int AS failures, (state = 'REVIEW_REQUIRED')::int AS reviews, {_COORD.format(label="label")} FROM r)
SELECT route_id::varchar AS route_id, event_id::double AS Timestamp_s, lat AS Latitude, lon AS Longitude, 'National Highway' AS Detected_Road_Type, 2 AS Expected_Lanes, CASE WHEN broken THEN '1 centre line(s) missing' ELSE 'Intact' END AS Lane_Integrity,
 CASE WHEN metric_key = 'min_kerb_height' AND n > 0 THEN 'Yes' ELSE 'No' END AS Kerb_Available, CASE WHEN contains(metric_key, 'barrier') AND n > 0 THEN 'Yes' ELSE 'No' END AS Crash_Barrier_Available,
 {_SHOWN.format(test="= 'min_radius_curvature'")} AS Radius_of_Curvature_Status, {_SHOWN.format(test="= 'min_lane_width'")} AS Lane_Width_Status, CASE WHEN metric_key <> 'min_lane_width' THEN 'ABSENT' WHEN state IN ('PASS', 'ABSENT') THEN state ELSE 'FAIL' END AS Overall_Lane_Width_Status,
 {_SHOWN.format(test="= 'min_kerb_height'")} AS Kerb_Height_Status, {_SHOWN.format(test="IN ('min_w_beam_barrier_height', 'min_concrete_barrier_height')")} AS Crash_Barrier_Status, {_SHOWN.format(test="= 'min_sign_height'")} AS Traffic_Sign_Height_Status, {_SEVERITY} AS Overall_Severity,
 CASE WHEN failures + reviews = 0 THEN 'All observed values meet their rules.' ELSE concat_ws(' ', advice, CASE WHEN broken THEN 'Markings: 1 centre line(s) missing.' END, CASE WHEN state = 'REVIEW_REQUIRED' THEN 'Undecided until reviewed: ' || CASE metric_key WHEN 'min_kerb_height' THEN 'kerb height' ELSE 'crash barrier height' END || '.' END,
  CASE WHEN state IN ('FAIL', 'REVIEW_REQUIRED') THEN 'Sources: ' || metric_key || ' source, p. 1.' END) END AS Professional_Suggestions, failures, reviews FROM t""")
def audit_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixteen-column report over all events as observation sheets of routes."""
    sheet = sheets(spark, sf_dir)
    routes = sheet.select("route_id").distinct()
    rule_rows = routes.crossJoin(F.broadcast(fx.rules(spark)))  # six rules
    ctx = routes.select("route_id", F.lit("National Highway").alias("road_class"), F.lit(1).alias("lanes_per_carriageway"), F.lit(2).alias("total_road_lanes"), F.lit("undivided").alias("carriageway"), F.lit("w_beam").alias("barrier_type"))
    return audit.audit_rows(sheet, rule_rows, ctx)


# --- text ----------------------------------------------------------------------------------------------------------

_MEASURE = r"(?i)(?:^|[^\w.])(\d+(?:,\d{3})*(?:\.\d+)?)\s*(mm|cm|km/h|km|m|metres?|meters?)\b"


@query(f"""WITH {fx.CHUNKS}, m AS (SELECT corpus_idx, unnest(regexp_extract_all(text, '{_MEASURE}', 1)) AS v, unnest(regexp_extract_all(text, '{_MEASURE}', 2)) AS u FROM chunk_v)
SELECT corpus_idx, count(*) AS n, round(sum(CASE lower(u) WHEN 'mm' THEN replace(v, ',', '')::double / 1000 WHEN 'cm' THEN replace(v, ',', '')::double / 100 WHEN 'km' THEN replace(v, ',', '')::double * 1000 WHEN 'km/h' THEN 0 ELSE replace(v, ',', '')::double END), 6) AS metres FROM m GROUP BY 1""")
def measurement_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.chunks(spark, sf_dir).select("corpus_idx", F.explode(text.measurements(F.col("text"))).alias("m"))
    return m.groupBy("corpus_idx").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.coalesce("m.value_m", F.lit(0.0))), 6).alias("metres"))


_WORDING = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{c}'" for c, p in text.COMPARATORS) + " END"


@query(f"WITH {fx.CHUNKS}, c AS (SELECT corpus_idx, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM chunk_v) SELECT corpus_idx, {_WORDING} AS said FROM c")
def comparator_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.chunks(spark, sf_dir).select("corpus_idx", text.comparator(F.col("text")).alias("said"))


@query(f"""WITH {fx.CHUNKS} SELECT corpus_idx, regexp_extract(text, '(\\d+) \\+/- (\\d+) mm', 1)::double - regexp_extract(text, '(\\d+) \\+/- (\\d+) mm', 2)::double AS low,
 regexp_extract(text, '(\\d+) \\+/- (\\d+) mm', 1)::double + regexp_extract(text, '(\\d+) \\+/- (\\d+) mm', 2)::double AS high FROM chunk_v WHERE regexp_matches(text, '\\d+ \\+/- \\d+ mm')""")
def tolerance_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.chunks(spark, sf_dir).withColumn("t", text.tolerance(F.col("text"))).where("t is not null")
    return c.select("corpus_idx", (F.col("t.centre") - F.col("t.spread")).alias("low"), (F.col("t.centre") + F.col("t.spread")).alias("high"))


@query(f"""WITH {fx.OBSERVATIONS}, p AS (SELECT event_id, regexp_extract(label, 'N: (\\d+\\.\\d+) E: (\\d+)\\. (\\d+)', 1) AS a, regexp_extract(label, 'N: (\\d+\\.\\d+) E: (\\d+)\\. (\\d+)', 2) AS b, regexp_extract(label, 'N: (\\d+\\.\\d+) E: (\\d+)\\. (\\d+)', 3) AS c FROM obs_v)
SELECT event_id, CASE WHEN try_cast(a AS double) <= 90 THEN try_cast(a AS double) END AS lat, CASE WHEN try_cast(a AS double) <= 90 THEN try_cast(b || '.' || c AS double) END AS lon FROM p""")
def coordinate_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.observations(spark, sf_dir).withColumn("at", text.coordinates(F.col("label")))
    return o.select("event_id", F.col("at.lat").alias("lat"), F.col("at.lon").alias("lon"))


@query(f"""WITH {fx.CHUNKS} SELECT corpus_idx, contains(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), lower('The   Kerb height SHALL be ' || (100 + corpus_idx % 300) || ' mm')) AS present FROM chunk_v""".replace("'The   Kerb", "'The Kerb"))
def quote_in_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    quote = F.concat(F.lit("The   Kerb height SHALL be "), (100 + F.col("corpus_idx") % 300).cast("string"), F.lit(" mm"))
    return fx.chunks(spark, sf_dir).select("corpus_idx", F.contains(text.match_form(F.col("text")), text.match_form(quote)).alias("present"))


@query(r"""WITH n AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(translate(coalesce(text, ''), chr(8), ' '), '[ \t]+', ' ', 'g'), '\n[ \t]+', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS t FROM documents)
SELECT doc_id, sha256(t) AS content_hash, length(t) AS n_chars, len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^(?i)(?:section\s+)?\d+(?:\.\d+){0,4}\s+[A-Za-z]'))) > 0 AS has_heading FROM n""")
def text_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.load(spark, sf_dir, "documents").withColumn("t", text.normalize_text(F.coalesce("text", F.lit(""))))
    heading = F.exists(F.split("t", "\n"), lambda x: x.rlike(text.NUMBERED_HEADING))
    return d.select("doc_id", F.sha2("t", 256).alias("content_hash"), F.length("t").cast("long").alias("n_chars"), heading.alias("has_heading"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN round_even((event_id % 120)::double * 1.609344::double, 1) ELSE (event_id % 120)::double END AS kmph,
 CASE WHEN event_id % 40 BETWEEN 1 AND 30 THEN (event_id % 40)::int END AS lanes,
 CASE event_id % 5 WHEN 0 THEN 'National Highway' WHEN 1 THEN 'State Highway' WHEN 2 THEN 'Expressway' WHEN 3 THEN 'Major District Road' ELSE 'Local Street' END AS road_class FROM events""")
def tag_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.load(spark, sf_dir, "events")
    n = lambda m: (F.col("event_id") % m).cast("string")
    speed = F.concat(n(120), F.when(F.col("event_id") % 3 == 0, " mph").otherwise(""))
    ref = F.element_at(F.array(F.lit("NH 65"), F.lit("x;SH-1"), F.lit("NE4"), F.lit("mdr 7"), F.lit(None)), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select("event_id", text.speed_kmph(speed).alias("kmph"), text.lane_count(F.concat(F.lit(" "), n(40))).alias("lanes"), text.road_class(ref, F.lit("residential"))["road_class"].alias("road_class"))


# --- retrieval -----------------------------------------------------------------------------------------------------

#: Query texts of the retrieval queries.
ASKED = ("minimum traffic lane width shall", "kerb height the of", "radius of a horizontal curve at least the the the")
_ASKED = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{t}')" for k, t in enumerate(ASKED)) + ") t(query_idx, query))"
_TOK = "list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+(?:[.:/-][a-z0-9]+)*'), lambda x: len(x) > 1 OR regexp_matches(x, '^[0-9]$'))"
_BM25 = f"""{fx.CHUNKS}, {_ASKED},
tok AS (SELECT corpus_idx, {_TOK.format(c="text")} AS ts FROM chunk_v), st AS (SELECT count(*) AS n, greatest(avg(len(ts)), 1) AS avgdl FROM tok),
qt AS (SELECT query_idx, token, least(count(*), 2) AS qtf FROM (SELECT query_idx, unnest({_TOK.format(c="query")}) AS token FROM q) GROUP BY ALL),
tf AS (SELECT corpus_idx, dl, token, count(*) AS tf FROM (SELECT corpus_idx, len(ts) AS dl, unnest(ts) AS token FROM tok) WHERE token IN (SELECT token FROM qt) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT query_idx, corpus_idx, round(sum(qtf * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl))), 9) AS score FROM tf JOIN df USING (token) JOIN qt USING (token), st GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_idx ORDER BY score DESC, corpus_idx) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 28)"""


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("r", k, t) for k, t in enumerate(ASKED)], "request_id string, query_idx int, query string")


def lexical(spark: SparkSession, sf_dir: str, k: int = 28) -> DataFrame:
    return retrieval.bm25(fx.chunks(spark, sf_dir), asked(spark), k)


@query(f"WITH {fx.CHUNKS}, t AS (SELECT len({_TOK.format(c='text')}) AS dl FROM chunk_v) SELECT count(*) AS n, round(greatest(avg(dl), 1), 6) AS avgdl FROM t")
def bm25_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.corpus_stats(fx.chunks(spark, sf_dir)).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {_BM25} SELECT query_idx, corpus_idx, rank, round(score, 6) AS score FROM rk")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical(spark, sf_dir).select("query_idx", "corpus_idx", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def scratch(spark: SparkSession, name: str) -> versions.Store:
    """A store of its own in the shared folder."""
    return versions.Store(spark, f"{versions.shared_dir(spark)}/{name}-{uuid.uuid4().hex}")


@query(f"WITH {_BM25} SELECT query_idx, corpus_idx, rank, round(score, 6) AS score FROM rk")
def bm25_stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages are indexed, a third of them in a draft that a second version replaces; the search reads the stored index alone."""
    store, c = scratch(spark, "stored-index"), fx.chunks(spark, sf_dir)
    drafts = F.col("corpus_idx") % 3 == 0
    draft = F.concat(F.lit("draft of a kerb height and a traffic lane width. "), F.col("text"))
    first = store.begin()
    inverted.update(first, c.withColumn("text", F.when(drafts, draft).otherwise(F.col("text"))))
    first.commit()
    second = store.begin()
    inverted.update(second, c.where(drafts), c.where(drafts).withColumn("text", draft))
    found = inverted.bm25(store, asked(spark), 28, second.commit())
    return found.select("query_idx", "corpus_idx", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {_BM25} SELECT corpus_idx, min(rank) AS rank, arg_min(query_idx, rank * 10 + query_idx) AS query_idx FROM rk GROUP BY 1")
def best_rank_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = retrieval.best_ranks(lexical(spark, sf_dir), "lexical")
    return b.select("corpus_idx", F.col("lexical_rank").cast("long").alias("rank"), F.col("lexical_query").alias("query_idx"))


_DENSE = """v AS (SELECT vec_id, embedding::double[] AS e FROM embeddings),
ds AS (SELECT a.vec_id AS query_id, b.vec_id AS corpus_idx, round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])), 6) AS score FROM v a, v b WHERE a.vec_id % 50 = 0),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_idx) AS rank FROM ds QUALIFY rank <= 28)"""


def dense_hits(spark: SparkSession, sf_dir: str, k: int = 28) -> DataFrame:
    """Queries are the vectors whose id is divisible by 50, against all vectors."""
    v = fx.load(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("request_id"), F.lit(0).alias("query_idx"), F.col("embedding").alias("query_vector"))
    return retrieval.dense(v.withColumnRenamed("vec_id", "corpus_idx"), q, k)


@query(f"WITH {_DENSE} SELECT query_id, count(*) AS n, round(sum(score), 3) AS total, arg_max(corpus_idx, score) AS first FROM dr GROUP BY 1")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dense_hits(spark, sf_dir)
    return d.groupBy(F.col("request_id").cast("long").alias("query_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 3).alias("total"), F.max_by("corpus_idx", "score").alias("first"))


@query(f"""WITH {_BM25}, l AS (SELECT corpus_idx, min(rank) AS r FROM rk GROUP BY 1),
s AS (SELECT corpus_idx, row_number() OVER (ORDER BY corpus_idx DESC) AS r FROM chunk_v WHERE regexp_matches(text, '(?i)\\b(?:lane|carriageway)\\b') QUALIFY r <= 60)
SELECT corpus_idx, round(coalesce(0.34::double / (60 + l.r), 0) + coalesce(0.20::double / (60 + s.r), 0), 9) AS fusion FROM l FULL JOIN s USING (corpus_idx)""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    lane = fx.chunks(spark, sf_dir).where(F.col("text").rlike(r"(?i)\b(?:lane|carriageway)\b")).select(F.lit("r").alias("request_id"), "corpus_idx", F.col("corpus_idx").alias("score"))
    found = retrieval.top(lane, ["request_id"], "score", 60)
    out = retrieval.fuse(None, retrieval.best_ranks(lexical(spark, sf_dir), "lexical"), found)
    return out.select("corpus_idx", F.round("fusion", 9).alias("fusion"))


@query()
def dense_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries of ``dense_topk`` against a stored approximate index of all vectors; ``found`` of them are in the exact top 28."""
    v = fx.load(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("request_id"), F.lit(0).alias("query_idx"), F.col("embedding").alias("query_vector"))
    store = scratch(spark, "dense-index")
    change = store.begin()
    ann.create(change, v, "vec_id")
    change.commit()
    exact = dense_hits(spark, sf_dir).select("request_id", "corpus_idx", F.lit(1).alias("hit"))
    got = ann.search(store, q, 28).join(exact, ["request_id", "corpus_idx"], "left")
    return got.groupBy(F.col("request_id").cast("long").alias("query_id")).agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("found"), F.round(F.sum("score"), 3).alias("total"))


_UNIT = r"(?i)\b\d+(?:\.\d+)?\s*(?:mm|cm|m|metres?|meters?|km|km/h)\b"
_LANE = catalog.METRICS["min_lane_width"]
_PHRASES = "[" + ", ".join(f"'{p}'" for p in _LANE.phrases) + "]"
_PREFERRED = " OR ".join(f"starts_with(standard_id, '{p}')" for p in _LANE.preferred)


def lane_request(spark: SparkSession) -> DataFrame:
    row = ("r", _LANE.feature, list(_LANE.phrases), list(_LANE.preferred), ["rural", "undivided", "shall"])
    return spark.createDataFrame([row], "request_id string, feature string, phrases array<string>, preferred array<string>, context_tokens array<string>")


@query(f"""WITH {fx.CHUNKS}, t AS (SELECT corpus_idx, standard_id, list_distinct({_TOK.format(c="text")}) AS ts FROM chunk_v WHERE regexp_matches(text, '(?i){_LANE.feature}') AND regexp_matches(text, '{_UNIT}')),
s AS (SELECT corpus_idx, list_max(list_transform({_PHRASES}, lambda p: len(list_intersect(list_distinct({_TOK.format(c="p")}), ts))::double / len(list_distinct({_TOK.format(c="p")})))) AS overlap,
 CASE WHEN {_PREFERRED} THEN 0.35::double ELSE 0 END AS bonus, least(len(list_intersect(ts, ['rural', 'undivided', 'shall']))::double / 3, 0.25::double) AS ctx FROM t),
r AS (SELECT corpus_idx, round(overlap + bonus + ctx, 9) AS score, row_number() OVER (ORDER BY round(overlap + bonus + ctx, 9) DESC, corpus_idx) AS rank FROM s WHERE overlap >= 0.34::double QUALIFY rank <= 60)
SELECT corpus_idx, rank, round(score, 6) AS score FROM r""")
def scan_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = retrieval.scan(fx.chunks(spark, sf_dir), lane_request(spark), 60)
    return s.select("corpus_idx", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


_WAYS = "['undivided', 'divided', 'unknown', 'one_way']"
_APPLIES = f"""a_v AS (SELECT corpus_idx, standard_id, w, lanes, CASE
 WHEN standard_id IN ('IRC:SP:73', 'IRC:SP:84', 'IRC:SP:87') THEN CASE
   WHEN w <> 'unknown' AND w <> (CASE standard_id WHEN 'IRC:SP:73' THEN 'undivided' ELSE 'divided' END) THEN 'inapplicable'
   WHEN lanes IS NOT NULL AND lanes <> (CASE standard_id WHEN 'IRC:SP:73' THEN 2 WHEN 'IRC:SP:84' THEN 4 ELSE 6 END) THEN 'inapplicable'
   WHEN w = 'unknown' OR lanes IS NULL THEN 'unknown' ELSE 'applicable' END
 WHEN standard_id = 'IRC:SP:99' THEN 'inapplicable' WHEN standard_id = 'IRC:86' THEN 'inapplicable' ELSE 'not_scoped' END AS status
 FROM (SELECT corpus_idx, standard_id, {_WAYS}[corpus_idx // 8 % 4 + 1] AS w, CASE WHEN corpus_idx // 32 % 4 > 0 THEN 2 * (corpus_idx // 32 % 4) END AS lanes FROM chunk_v))"""


def applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.chunks(spark, sf_dir)
    way = F.get(F.array(*map(F.lit, ("undivided", "divided", "unknown", "one_way"))), F.expr("cast(corpus_idx div 8 % 4 as int)"))
    lanes = F.expr("case when corpus_idx div 32 % 4 > 0 then cast(2 * (corpus_idx div 32 % 4) as int) end")
    return c.withColumn("status", context.applicability(F.lit("min_lane_width"), F.col("standard_id"), way, lanes, F.lit("National Highway"), F.lit("rural")))


@query(f"WITH {fx.CHUNKS}, {_APPLIES} SELECT corpus_idx, status FROM a_v")
def applicability_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return applied(spark, sf_dir).select("corpus_idx", "status")


@query(f"""WITH {fx.CHUNKS}, {_APPLIES}, b AS (SELECT c.*, a.status, 1.0::double / (60 + corpus_idx % 40) AS base, {_TOK.format(c="text")} AS ts, array_to_string({_TOK.format(c="text")}, ' ') AS tt FROM chunk_v c JOIN a_v a USING (corpus_idx)),
m AS (SELECT *, len(list_intersect(list_distinct({_TOK.format(c="'minimum traffic lane width standard'")}), ts))::double / 5 AS ov, contains(tt, 'traffic lane width') AS ex, regexp_matches(text, '{_UNIT}') AS un FROM b)
SELECT corpus_idx, round(base * (CASE WHEN {_PREFERRED} THEN 1.18::double ELSE 1 END) * (CASE status WHEN 'applicable' THEN 1.65::double WHEN 'unknown' THEN 0.72::double ELSE 1 END) * (1 + least(ov, 0.35::double))
 * (CASE WHEN ex THEN 1.28::double ELSE 1 END) * (CASE WHEN un THEN 1.12::double ELSE 0.82::double END) + (CASE WHEN ex AND un THEN 0.022::double ELSE 0 END), 9) AS score FROM m""")
def score_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = applied(spark, sf_dir)
    wanted = F.array_distinct(text.tokens(F.lit("minimum traffic lane width standard")))
    overlap = F.size(F.array_intersect(wanted, text.tokens(F.col("text")))) / F.lit(5)
    score = retrieval.priors(
        F.lit(1.0) / (60 + F.col("corpus_idx") % 40), preferred=retrieval.preferred_standard(F.col("standard_id"), F.array(*map(F.lit, _LANE.preferred))),
        multiplier=context.context_multiplier(F.lit("min_lane_width"), F.col("standard_id"), F.col("status"), F.lit("National Highway")), overlap=overlap,
        exact=F.contains(text.token_text(F.col("text")), F.lit("traffic lane width")), unit=text.has_value_with_unit(F.col("text")),
    )
    return c.select("corpus_idx", F.round(score, 9).alias("score"))


_HITS = "h AS (SELECT 'r' || (corpus_idx % 7) AS request_id, corpus_idx, source, source_path, page, chunk_index, substr(content_hash, 1, 2) AS evidence_id, content_hash AS provenance, (corpus_idx * 7919 % 10007)::double / 10007 AS score FROM chunk_v)"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.chunks(spark, sf_dir)
    return c.select(F.concat(F.lit("r"), (F.col("corpus_idx") % 7).cast("string")).alias("request_id"), "corpus_idx", "source", "source_path", "page", "chunk_index", F.substring("content_hash", 1, 2).alias("evidence_id"), F.col("content_hash").alias("provenance"), ((F.col("corpus_idx") * 7919 % 10007) / F.lit(10007.0)).alias("score"))


@query(f"""WITH {fx.CHUNKS}, {_HITS}, b AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, corpus_idx) AS rn FROM h QUALIFY rn <= 10),
w AS (SELECT request_id, source_path, score, chunk_index + o AS ci FROM b, (VALUES (-2), (-1), (1), (2)) t(o))
SELECT w.request_id, c.corpus_idx, round(w.score * 0.92::double, 9) AS score FROM w JOIN chunk_v c ON c.source_path = w.source_path AND c.chunk_index = w.ci""")
def neighbour_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = retrieval.neighbours(hits(spark, sf_dir), fx.chunks(spark, sf_dir).select("source_path", "chunk_index", "corpus_idx"), hit_limit=10, window=2)
    return n.select("request_id", "corpus_idx", F.round("score", 9).alias("score"))


@query(f"""WITH {fx.CHUNKS}, {_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY request_id, evidence_id ORDER BY score DESC, corpus_idx) AS a, row_number() OVER (PARTITION BY request_id, provenance ORDER BY score DESC, corpus_idx) AS b FROM h)
SELECT request_id, corpus_idx, evidence_id FROM r WHERE a = 1 AND b = 1""")
def dedup_two_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.dedup(hits(spark, sf_dir)).select("request_id", "corpus_idx", "evidence_id")


@query(f"""WITH {fx.CHUNKS}, {_HITS}, a AS (SELECT *, row_number() OVER (PARTITION BY request_id, source, page ORDER BY score DESC, corpus_idx) AS n FROM h QUALIFY n <= 2),
b AS (SELECT * EXCLUDE n, row_number() OVER (PARTITION BY request_id, source ORDER BY score DESC, corpus_idx) AS n FROM a QUALIFY n <= 4)
SELECT request_id, corpus_idx, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, corpus_idx) AS final_rank FROM b QUALIFY final_rank <= 12""")
def diversify_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.diversify(hits(spark, sf_dir), 12).select("request_id", "corpus_idx", F.col("final_rank").cast("long").alias("final_rank"))


@query(f"""WITH {fx.CHUNKS}, {_HITS}, b AS (SELECT h.*, length(c.text) AS n FROM h JOIN chunk_v c USING (corpus_idx)),
t AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, corpus_idx) AS rn FROM b QUALIFY rn <= 30),
s AS (SELECT *, greatest((n % 97)::double / 10 - 5, ((n + 31) % 97)::double / 10 - 5) AS raw, (score - min(score) OVER (PARTITION BY request_id)) / (max(score) OVER (PARTITION BY request_id) - min(score) OVER (PARTITION BY request_id)) AS f FROM t)
SELECT request_id, corpus_idx, round(0.88::double / (1 + exp(-raw)) + 0.12::double * f, 9) AS score FROM s""")
def rerank_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two queries a hit and an arithmetic scorer in the model's place."""
    h = retrieval.top(hits(spark, sf_dir), ["request_id"], "score", 30).drop("rank").join(fx.chunks(spark, sf_dir).select("corpus_idx", "text"), "corpus_idx")
    scorer = lambda p: p.withColumn("raw", ((F.length("text") + F.when(F.col("query") == "b", 31).otherwise(0)) % 97) / F.lit(10.0) - 5)
    out = retrieval.rerank(h.withColumn("queries", F.array(F.lit("a"), F.lit("b"))), scorer)
    return out.select("request_id", "corpus_idx", F.round("score", 9).alias("score"))


@query(f"""WITH {fx.CHUNKS}, r AS (SELECT source AS request_id, corpus_idx, row_number() OVER (PARTITION BY source ORDER BY corpus_idx) AS rank,
 length('[E' || corpus_idx || '] source=' || source || '; standard=' || standard_id || '; edition=' || edition_year || '; page=' || page || '; section=unknown' || chr(10) || trim(text)) AS n FROM chunk_v),
u AS (SELECT *, sum(n) OVER (PARTITION BY request_id ORDER BY rank) AS used FROM r) SELECT request_id, corpus_idx, used::bigint AS used FROM u WHERE rank = 1 OR used <= 18000""")
def evidence_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.chunks(spark, sf_dir).withColumn("request_id", F.col("source")).withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("corpus_idx"))).withColumn("evidence_id", F.concat(F.lit("E"), F.col("corpus_idx").cast("string"))).withColumn("section", F.lit(None).cast("string"))
    return retrieval.evidence_blocks(c).select("request_id", "corpus_idx", "used")


# --- corpus --------------------------------------------------------------------------------------------------------

_FOUND = "f AS (SELECT '/in/' || doc_id AS source_path, sha256(coalesce(text, '')) AS document_sha256, doc_id FROM documents)"
_MANIFEST = "m AS (SELECT CASE WHEN doc_id % 2 = 0 THEN '/else/' || doc_id WHEN doc_id % 10 = 3 THEN '/old/' || doc_id ELSE source_path END AS source_path, CASE WHEN doc_id % 2 = 0 OR doc_id % 10 = 5 THEN 'changed ' || doc_id ELSE document_sha256 END AS document_sha256, CASE WHEN doc_id % 10 = 7 THEN 'v0' ELSE 'v1' END AS v FROM f)"


def found_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.load(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string")).alias("source_path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("document_sha256"), F.lit("v1").alias("chunking_version"), F.lit("i1").alias("identity_version"), "doc_id")


def known_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest with a row a document, half of them of other files and some under old paths, digests or versions."""
    f = found_files(spark, sf_dir)
    n, i = F.col("doc_id") % 10, F.col("doc_id").cast("string")
    return f.select(F.when(n % 2 == 0, F.concat(F.lit("/else/"), i)).when(n == 3, F.concat(F.lit("/old/"), i)).otherwise(F.col("source_path")).alias("source_path"), F.when((n % 2 == 0) | (n == 5), F.concat(F.lit("changed "), i)).otherwise(F.col("document_sha256")).alias("document_sha256"), F.when(n == 7, "v0").otherwise("v1").alias("chunking_version"), "identity_version")


@query(f"WITH {_FOUND}, {_MANIFEST} SELECT source_path FROM f WHERE EXISTS (SELECT 1 FROM m WHERE m.source_path = f.source_path AND m.document_sha256 = f.document_sha256 AND m.v = 'v1')")
def unchanged_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.unchanged(found_files(spark, sf_dir), known_files(spark, sf_dir)).select("source_path")


@query(f"""WITH {_FOUND}, {_MANIFEST}, a AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.source_path = f.source_path AND m.document_sha256 = f.document_sha256 AND m.v = 'v1')),
b AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.document_sha256 = a.document_sha256 AND m.source_path <> a.source_path))
SELECT min(source_path) AS source_path FROM b GROUP BY document_sha256""")
def incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.to_index(found_files(spark, sf_dir), known_files(spark, sf_dir)).select("source_path")


@query(f"WITH {_FOUND}, x AS (SELECT document_sha256, min(source_path) AS first_path FROM f GROUP BY 1) SELECT source_path, first_path FROM f JOIN x USING (document_sha256) WHERE source_path <> first_path")
def duplicate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.duplicate_content(found_files(spark, sf_dir))


@query(f"WITH {_FOUND}, {_MANIFEST} SELECT source_path FROM m WHERE starts_with(source_path, '/old/') AND source_path NOT IN (SELECT source_path FROM f)")
def prune_gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.to_prune(known_files(spark, sf_dir), found_files(spark, sf_dir), ["/old"]).select("source_path")


@query(f"WITH {_FOUND}, {_MANIFEST} SELECT doc_id FROM f WHERE document_sha256 IN (SELECT document_sha256 FROM m)")
def structured_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = found_files(spark, sf_dir).select("doc_id", F.col("document_sha256").alias("source_sha256"))
    return corpus.structured_hits(r, known_files(spark, sf_dir)).select("doc_id")


_POLICY = """d AS (SELECT '/in/' || doc_id AS source_path, 'file-' || (doc_id % 40) AS source, sha256(coalesce(text, '')) AS sha FROM documents),
h AS (SELECT sha, 'S' || min(doc_id) AS id FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN sha256(coalesce(text, '')) END AS sha FROM documents) GROUP BY sha HAVING count(*) = 1 AND sha IS NOT NULL)"""


@query(f"""WITH {_POLICY} SELECT source_path, coalesce(h.id, CASE WHEN source IN ('file-1', 'file-2') THEN 'NAME' WHEN source = 'file-5' THEN 'ALIAS' END) AS standard_id,
 CASE WHEN h.id IS NOT NULL THEN 'registry_sha256' WHEN source IN ('file-1', 'file-2') THEN 'registry_source' WHEN source = 'file-5' THEN 'registry_alias' END AS method FROM d LEFT JOIN h USING (sha)""")
def policy_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.load(spark, sf_dir, "documents")
    docs = d.select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string")).alias("source_path"), F.concat(F.lit("file-"), (F.col("doc_id") % 40).cast("string")).alias("source"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("document_sha256"))
    by_sha = d.select(F.concat(F.lit("S"), F.col("doc_id").cast("string")).alias("standard_id"), F.lit(2000).alias("active_edition_year"), F.when(F.col("doc_id") % 4 == 0, F.array(F.sha2(F.coalesce("text", F.lit("")), 256))).otherwise(F.array().cast("array<string>")).alias("approved_sha256"), F.array().cast("array<string>").alias("approved_sources"), F.array().cast("array<string>").alias("source_aliases"))
    named = spark.createDataFrame([("NAME", 2001, [], ["FILE-1", "file-2"], []), ("ALIAS", 2002, [], [], ["file-5", "file-6"]), ("OTHER", 2003, [], [], ["file-6"])], "standard_id string, active_edition_year int, approved_sha256 array<string>, approved_sources array<string>, source_aliases array<string>")
    return corpus.resolve_policies(docs, by_sha.unionByName(named)).select("source_path", "standard_id", "method")


@query(f"""WITH {fx.CHUNKS} SELECT corpus_idx, CASE corpus_idx % 4 WHEN 3 THEN NULL ELSE 'IRC:' || (CASE WHEN corpus_idx % 2 = 0 THEN 'SP:' ELSE '' END) || (corpus_idx % 120 + 1) END AS standard_id,
 CASE corpus_idx % 4 WHEN 0 THEN 'cover_regex' WHEN 1 THEN 'filename_regex' WHEN 2 THEN 'ocr_normalized_cover' ELSE 'unknown' END AS method,
 CASE WHEN corpus_idx % 4 < 3 THEN 1960 + corpus_idx % 60 END AS edition_year FROM chunk_v""")
def identity_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.chunks(spark, sf_dir)
    name = F.concat(F.when(F.col("corpus_idx") % 2 == 0, "SP:").otherwise(""), (F.col("corpus_idx") % 120 + 1).cast("string"), F.lit("-"), (1960 + F.col("corpus_idx") % 60).cast("string"))
    n = F.col("corpus_idx") % 4
    docs = c.select(
        "corpus_idx", F.col("corpus_idx").cast("string").alias("source_path"), F.when(n == 1, F.concat(F.lit("IRC "), name, F.lit(".pdf"))).otherwise("scan.pdf").alias("source"), F.lit("none").alias("document_sha256"),
        F.when(n == 0, F.concat(F.lit("Code of IRC:"), name)).when(n == 2, F.concat(F.lit("Code of 1RC:"), name)).otherwise("no title").alias("cover"),
    )
    empty = spark.createDataFrame([], "standard_id string, active_edition_year int, approved_sha256 array<string>, approved_sources array<string>, source_aliases array<string>")
    return corpus.identify(docs, empty).select("corpus_idx", "standard_id", "method", F.col("edition_year").cast("long").alias("edition_year"))


@query(f"WITH {fx.CHUNKS} SELECT standard_id, array_to_string(list_sort(list_distinct(list(edition_year))), ',') AS editions FROM chunk_v GROUP BY 1")
def editions_per_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.editions(fx.chunks(spark, sf_dir)).select("standard_id", F.array_join(F.transform("editions", lambda x: x.cast("string")), ",").alias("editions"))


@query("WITH d AS (SELECT 'S' || (doc_id % 777) AS standard_id, 1990 + doc_id % 3 AS y FROM documents) SELECT standard_id, count(*) AS documents, array_to_string(list_sort(list_distinct(list(y))), ',') AS editions FROM d GROUP BY 1 HAVING count(*) > 1")
def edition_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.load(spark, sf_dir, "documents").select(F.concat(F.lit("S"), (F.col("doc_id") % 777).cast("string")).alias("standard_id"), (1990 + F.col("doc_id") % 3).alias("edition_year"))
    return corpus.edition_conflicts(d).select("standard_id", "documents", F.array_join(F.transform("editions", lambda x: x.cast("string")), ",").alias("editions"))


@query(r"""WITH p AS (SELECT doc_id AS page, sha256(source) AS sha, unnest(range(2)) AS part, coalesce(text, '') AS text FROM documents),
t AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(text || ' part ' || part, '[ \t]+', ' ', 'g'), '\n[ \t]+', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS n FROM p)
SELECT page, part AS page_chunk_index, sha256(sha || ':' || page || ':' || part || ':' || sha256(n)) AS chunk_id FROM t""")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.sha2("source", 256).alias("document_sha256"), F.explode(F.array(F.lit(0), F.lit(1))).alias("part"), F.coalesce("text", F.lit("")).alias("t"))
    parts = d.withColumn("text", F.concat("t", F.lit(" part "), F.col("part").cast("string"))).drop("t")
    return chunking.assemble(parts).select("page", F.col("page_chunk_index").cast("long").alias("page_chunk_index"), "chunk_id")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk_index FROM conversations")
def chunk_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.load(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("conv_id").cast("string").alias("document_sha256"), F.col("turn").alias("page"), F.lit(0).alias("part"), "text")
    return chunking.assemble(c).select("conv_id", "turn", F.col("chunk_index").cast("long").alias("chunk_index"))


@query(r"""WITH p AS (SELECT source AS doc, length(regexp_replace(coalesce(text, ''), '\s+', '', 'g')) < 80 AS weak FROM documents)
SELECT doc, count(*) AS pages, count(*) FILTER (weak) AS low_text_pages, round_even(1 - avg(weak::int), 4) AS coverage FROM p GROUP BY 1""")
def page_text_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as pages of their sources; the short ones are weak."""
    p = fx.load(spark, sf_dir, "documents").select(F.col("source").alias("doc"), "text", F.lit("text").alias("parser"))
    return corpus.page_coverage(p, "doc").drop("parsers")


_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(translate({c}, chr(8), ' '), '[ \t]+', ' ', 'g'), '\n[ \t]+', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query(f"""WITH {fx.CHUNKS}, p AS (SELECT source_path, corpus_idx AS page, CASE WHEN corpus_idx % 6 = 0 THEN 'weak' ELSE text END AS t, 'Fig. 3 rail' || chr(10) || text || chr(10) || '730 +/- 25 mm' || chr(10) || 'plain words only' AS o FROM chunk_v),
n AS (SELECT *, length(regexp_replace(t, '\\s+', '', 'g')) < 80 AS weak, list_filter(['Fig. 3 rail', '730 +/- 25 mm'], lambda x: NOT contains(lower({_CLEAN.format(c='t')}), lower(x))) AS more FROM p)
SELECT source_path, page, CASE WHEN weak THEN o WHEN len(more) = 0 THEN t ELSE {_CLEAN.format(c="t || chr(10) || chr(10) || '[OCR figure/table supplement]' || chr(10) || array_to_string(more, chr(10))")} END AS text, CASE WHEN weak THEN 'ocr' WHEN len(more) = 0 THEN 'base' ELSE 'base+ocr' END AS parser FROM n""")
def ocr_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.chunks(spark, sf_dir)
    base = c.select("source_path", F.col("corpus_idx").alias("page"), F.when(F.col("corpus_idx") % 6 == 0, "weak").otherwise(F.col("text")).alias("text"), F.lit("base").alias("parser"))
    ocr = c.select("source_path", F.col("corpus_idx").alias("page"), F.concat(F.lit("Fig. 3 rail\n"), F.col("text"), F.lit("\n730 +/- 25 mm\nplain words only")).alias("text"), F.lit("ocr").alias("parser"))
    return corpus.merge_ocr(base, ocr)


_STRIP = "trim({c}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query(rf"""WITH RECURSIVE n AS (SELECT doc_id, {_CLEAN.format(c="coalesce(text, '')")} AS t FROM documents),
g AS (SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(t, '\n\s*\n'), lambda x: {_STRIP.format(c="x")}), lambda x: x <> '')) AS para, generate_subscripts(list_filter(list_transform(string_split_regex(t, '\n\s*\n'), lambda x: {_STRIP.format(c="x")}), lambda x: x <> ''), 1) AS g FROM n),
w AS (SELECT doc_id, g, para, 0 AS pos FROM g UNION ALL SELECT doc_id, g, para, greatest(pos + CASE WHEN regexp_matches(substr(para, pos + 301, 1100), '[ \n]') THEN length(regexp_extract(substr(para, pos + 301, 1100), '(?s)^(.*)[ \n]', 1)) + 301 ELSE 1400 END - 220, pos + 1) FROM w WHERE pos + 1400 < length(para)),
p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g, pos) AS i, {_STRIP.format(c="substr(para, pos + 1, CASE WHEN pos + 1400 >= length(para) THEN 1400 WHEN regexp_matches(substr(para, pos + 301, 1100), '[ \n]') THEN length(regexp_extract(substr(para, pos + 301, 1100), '(?s)^(.*)[ \n]', 1)) + 301 ELSE 1400 END)")} AS piece FROM w),
f AS (SELECT doc_id, i, piece AS open, NULL::varchar AS done FROM p WHERE i = 1 UNION ALL
 SELECT f.doc_id, p.i, CASE WHEN open <> '' AND length({_STRIP.format(c="open || chr(10) || chr(10) || piece")}) > 1400 THEN {_STRIP.format(c="trim(substr(right(open, 220), greatest(instr(right(open, 220), '. '), instr(right(open, 220), chr(10))) + 1), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) || chr(10) || chr(10) || piece")}
   WHEN open = '' THEN piece ELSE {_STRIP.format(c="open || chr(10) || chr(10) || piece")} END, CASE WHEN open <> '' AND length({_STRIP.format(c="open || chr(10) || chr(10) || piece")}) > 1400 THEN open END FROM f JOIN p ON p.doc_id = f.doc_id AND p.i = f.i + 1),
o AS (SELECT doc_id, i, {_STRIP.format(c="done")} AS text FROM f WHERE done IS NOT NULL UNION ALL SELECT doc_id, i + 1, {_STRIP.format(c="open")} FROM f QUALIFY i = max(i) OVER (PARTITION BY doc_id))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::int AS part, text, 'prose' AS content_type, NULL::varchar AS table_id, NULL::varchar AS table_caption, NULL::varchar AS table_header, NULL::int AS table_row_start, NULL::int AS table_row_end FROM o WHERE length(text) >= 40""")
def chunker(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return chunking.split_pages(d)


_LEAD = "'Section: 3.1 Widths' || chr(10) || 'Table: Table 1 of words' || chr(10) || '| no | word |' || chr(10) || '|---|---|'"


@query(rf"""WITH RECURSIVE s AS (SELECT conv_id, turn, string_split_regex(text, '\s+') AS ws FROM conversations WHERE text IS NOT NULL),
r AS (SELECT conv_id, turn, generate_subscripts(ws, 1) AS k, regexp_replace('| ' || generate_subscripts(ws, 1) || ' | ' || replace(unnest(ws), '|', '/') || ' |', ' +', ' ', 'g') AS line FROM s),
g AS (SELECT conv_id, turn, k, 0 AS grp, length({_LEAD}) + 1 + length(line) AS used, line FROM r WHERE k = 1 UNION ALL
 SELECT r.conv_id, r.turn, r.k, CASE WHEN used + 1 + length(r.line) > 540 THEN grp + 1 ELSE grp END, CASE WHEN used + 1 + length(r.line) > 540 THEN length({_LEAD}) + 1 + length(r.line) ELSE used + 1 + length(r.line) END, r.line FROM g JOIN r ON r.conv_id = g.conv_id AND r.turn = g.turn AND r.k = g.k + 1),
h AS (SELECT conv_id, turn, 'T-' || substr(sha256('| no | word |' || chr(10) || '|---|---|' || chr(10) || string_agg(line, chr(10) ORDER BY k)), 1, 16) AS table_id FROM r GROUP BY ALL)
SELECT g.conv_id, g.turn, grp::int AS part, {_LEAD} || chr(10) || string_agg(line, chr(10) ORDER BY k) AS text, 'table' AS content_type, any_value(h.table_id) AS table_id, 'Table 1 of words' AS table_caption, '| no | word |' || chr(10) || '|---|---|' AS table_header, min(k)::int AS table_row_start, max(k)::int AS table_row_end
FROM g JOIN h ON h.conv_id = g.conv_id AND h.turn = g.turn GROUP BY g.conv_id, g.turn, grp""")
def table_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation turn as a heading, a caption and a table of its words."""
    c = fx.load(spark, sf_dir, "conversations")
    rows = F.array_join(F.transform(F.split("text", r"\s+"), lambda w, k: F.concat(F.lit("| "), (k + 1).cast("string"), F.lit(" | "), F.replace(w, F.lit("|"), F.lit("/")), F.lit(" |"))), "\n")
    page = F.concat(F.lit("# 3.1 Widths\n\nTable 1 of words\n| no | word |\n|---|---|\n"), rows, F.lit("\n\nEnd."))
    return chunking.split_pages(c.select("conv_id", "turn", page.alias("text")), size=400, overlap=60)


@query()
def fuzzy_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_path"), F.concat(F.lit("scan I R C sp"), (F.col("doc_id") % 99).cast("string"), F.lit(".pdf")).alias("source"), F.col("text").alias("cover"))
    return corpus.fuzzy_candidates(d, list(fx.STANDARDS))


# --- rules ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {fx.CHUNKS}, m AS (SELECT corpus_idx, CASE corpus_idx % 5 WHEN 0 THEN (2500 + (corpus_idx % 20) * 100)::double WHEN 1 THEN (100 + corpus_idx % 300)::double WHEN 3 THEN (100 + corpus_idx % 800)::double END AS raw FROM chunk_v)
SELECT corpus_idx, raw, CASE corpus_idx % 5 WHEN 1 THEN '=' ELSE '>=' END AS comparator FROM m WHERE raw IS NOT NULL AND (corpus_idx % 5 <> 1 OR raw BETWEEN 50 AND 600) AND (corpus_idx % 5 <> 0 OR raw BETWEEN 2000 AND 5500)""")
def clause_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage is a request for the metric its clause is about."""
    key = F.expr("case corpus_idx % 5 when 0 then 'min_lane_width' when 1 then 'min_kerb_height' when 3 then 'min_radius_curvature' else 'none' end")
    h = fx.chunks(spark, sf_dir).select(F.col("corpus_idx").cast("string").alias("request_id"), key.alias("metric_key"), F.lit(1).alias("rank"), F.lit("e").alias("evidence_id"), "text")
    return rules.extract_clauses(h).select(F.col("request_id").cast("long").alias("corpus_idx"), F.col("raw_value").alias("raw"), "comparator")


_PROPOSALS = """p AS (SELECT corpus_idx, CASE WHEN corpus_idx % 7 = 0 THEN 'not in there 3 mm' WHEN corpus_idx % 7 = 6 THEN '' ELSE 'The kerb height shall be ' || (100 + corpus_idx % 300) || ' mm' END AS quote,
 (CASE WHEN corpus_idx % 7 = 1 THEN 99 ELSE 100 + corpus_idx % 300 END)::double AS raw, CASE WHEN corpus_idx % 7 = 2 THEN 'km/h' ELSE 'mm' END AS unit, CASE corpus_idx % 7 WHEN 3 THEN NULL WHEN 4 THEN '>=' ELSE '=' END AS cmp FROM chunk_v)"""


@query(f"""WITH {fx.CHUNKS}, {_PROPOSALS} SELECT corpus_idx, CASE WHEN quote = '' THEN 'no_quote' WHEN corpus_idx % 7 = 0 OR corpus_idx % 5 <> 1 THEN 'quote_not_in_passage'
 WHEN unit = 'km/h' THEN 'not_a_length' WHEN cmp IS NULL THEN 'no_relation' WHEN raw = 99 THEN 'value_not_in_quote' WHEN cmp = '>=' THEN 'relation_not_stated' END AS error FROM p""")
def evidence_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.chunks(spark, sf_dir)
    n, v = F.col("corpus_idx") % 7, 100 + F.col("corpus_idx") % 300
    x = c.select(
        "corpus_idx", F.lit("min_kerb_height").alias("metric_key"), F.lit("kerb height").alias("metric_name"), F.col("text").alias("hit_text"),
        F.when(n == 0, "not in there 3 mm").when(n == 6, "").otherwise(F.concat(F.lit("The kerb height shall be "), v.cast("string"), F.lit(" mm"))).alias("quote"), F.when(n == 1, 99).otherwise(v).cast("double").alias("raw_value"), F.lit(None).cast("double").alias("second_raw_value"),
        F.when(n == 2, "km/h").otherwise("mm").alias("raw_unit"), F.when(n == 4, ">=").when(n != 3, "=").alias("comparator"), F.lit(None).cast("string").alias("applies_to"), F.array().cast("array<string>").alias("conditions"), F.lit("").alias("context_text"),
    )
    return x.select("corpus_idx", rules.evidence_error(x).alias("error"))


@query(f"""WITH {fx.CHUNKS}, b AS (SELECT corpus_idx, standard_id IN ('IRC:86', 'IRC:SP:84', 'IRC:SP:99') AS pref, corpus_idx % 6 <> 0 AS paged, corpus_idx % 4 < 2 AS top FROM chunk_v)
SELECT corpus_idx, round_even(greatest(0, least(0.62::double + (CASE WHEN paged THEN 0.08::double ELSE 0 END) + (CASE WHEN pref THEN 0.08::double ELSE 0 END) + (CASE WHEN top THEN 0.06::double ELSE 0 END) + 0.0::double - 0.04::double, CASE WHEN paged THEN 1.0 ELSE 0.60 END, 0.55)), 3)::double AS score,
 (NOT paged)::int + (NOT pref)::int + 1 AS blockers FROM b""")
def evidence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict mode without a verified policy: the score is capped and every passage is blocked."""
    c = fx.chunks(spark, sf_dir)
    x = c.select(
        "corpus_idx", F.when(F.col("corpus_idx") % 6 != 0, F.col("page")).alias("page"), "standard_id", "edition_year", "source", F.col("content_hash").alias("sha"), F.when(F.col("corpus_idx") % 4 < 2, 1).otherwise(9).alias("rank"), "text",
        F.array(*map(F.lit, catalog.METRICS["min_kerb_height"].preferred)).alias("preferred"), F.lit("setting: nowhere-at-all").alias("context_text"), F.array(F.lit(1990)).alias("editions"), F.lit(None).cast("boolean").alias("verified"), F.lit(None).cast("int").alias("active_edition_year"),
        F.lit(None).cast("array<string>").alias("approved_sources"), F.lit(None).cast("array<string>").alias("approved_sha256"),
    )
    q = rules.evidence_quality(x)
    return x.select("corpus_idx", q["score"].alias("score"), F.size(q["blockers"]).alias("blockers"))


# --- evaluation ----------------------------------------------------------------------------------------------------

_ACC = ", ".join(f"round_even(avg({c}::int), 4) AS {c.replace('_match', '_accuracy')}" for c in evaluation.FLAGS[:-1])


@query(f"""WITH {fx.GOLD}, k AS (SELECT *, list_filter([citation_match, standard_match, edition_match, value_match, comparator_match, applicability_match, audit_decision_match], lambda x: x IS NOT NULL) AS fl FROM gold_v),
o AS (SELECT *, CASE WHEN len(fl) > 0 THEN NOT list_contains(fl, false) END AS overall_correct FROM k)
SELECT count(*) AS cases, round_even(avg(coalesce(first_rank <= 5, false)::int), 4) AS recall_at_5, round_even(avg(coalesce(first_rank <= 10, false)::int), 4) AS recall_at_10, round_even(avg(coalesce(1.0::double / first_rank, 0)), 4) AS mrr,
 {_ACC}, round_even(avg(overall_correct::int), 4) AS overall_correct, round_even(count(*) FILTER (expected_abstention AND predicted_abstention)::double / nullif(count(*) FILTER (predicted_abstention), 0), 4) AS abstention_precision,
 round_even(count(*) FILTER (expected_abstention AND predicted_abstention)::double / nullif(count(*) FILTER (expected_abstention), 0), 4) AS abstention_recall FROM o""")
def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.summarize(evaluation.case_records(fx.gold(spark, sf_dir)))


@query("SELECT event_type AS metric_key, count(*) AS n, round_even(avg(value), 3) AS mean_ms, round_even(median(value), 3) AS median_ms, round_even(quantile_disc(value, 0.95), 3) AS p95_ms FROM events GROUP BY 1")
def latency_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.latency(fx.load(spark, sf_dir, "events").select(F.col("event_type").alias("metric_key"), F.col("value").alias("total_latency_ms")))


@query("WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, value AS upper_median FROM r WHERE rn = n // 2 + 1")
def upper_median_by_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.upper_median_by(fx.load(spark, sf_dir, "events"), "user_id", "value")


# --- geometry ------------------------------------------------------------------------------------------------------

_POINTS = "p AS (SELECT event_id, user_id, 17 + (event_id % 100) * 0.001::double AS lat, 78 + (event_id * 7 % 100) * 0.001::double AS lon FROM events)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.load(spark, sf_dir, "events")
    return e.select("event_id", "user_id", (17 + (F.col("event_id") % 100) * F.lit(0.001)).alias("lat"), (78 + (F.col("event_id") * 7 % 100) * F.lit(0.001)).alias("lon"))


_HAV = "2 * 6371000.0::double * asin(sqrt(least(1.0::double, pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"


@query(f"""WITH {_POINTS}, n AS (SELECT *, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, count(nlat) AS steps, round(sum({_HAV.format(a="", b="n")}), 3) AS metres, round(sum(((degrees(atan2(sin(radians(nlon - lon)) * cos(radians(nlat)), cos(radians(lat)) * sin(radians(nlat)) - sin(radians(lat)) * cos(radians(nlat)) * cos(radians(nlon - lon)))) + 360) % 360 + 360) % 360), 3) AS turned FROM n GROUP BY 1""")
def haversine_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    n = points(spark, sf_dir).withColumn("a", F.lead("lat").over(w)).withColumn("b", F.lead("lon").over(w))
    c = F.col
    return n.groupBy("user_id").agg(F.count("a").alias("steps"), F.round(F.sum(geo.distance_m(c("lat"), c("lon"), c("a"), c("b"))), 3).alias("metres"), F.round(F.sum(geo.bearing(c("lat"), c("lon"), c("a"), c("b"))), 3).alias("turned"))


@query(f"""WITH {_POINTS}, s AS (SELECT user_id, count(*) AS n FROM p GROUP BY 1), i AS (SELECT user_id, n, unnest(range(7)) AS k FROM s),
w AS (SELECT DISTINCT user_id, CASE WHEN n > 7 THEN round_even(k * (n - 1)::double / 6, 0)::bigint ELSE k END AS pos FROM i WHERE n > 7 OR k < n),
o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM p) SELECT user_id, event_id FROM o JOIN w USING (user_id, pos)""")
def trajectory_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumn("pos", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long"))
    return context.sample_trajectory(p, 7, "user_id").select("user_id", "event_id")


@query(f"""WITH {_POINTS}, o AS (SELECT * FROM (VALUES (0, 'A', 'NH65', 17.0, 17.04, 78.0, 78.05), (1, 'B', 'NH65', 17.02, 17.1, 78.02, 78.1), (2, 'C', 'SH1', 17.0, 17.1, 78.0, 78.1)) t(position, id, ref, a, b, c, d)),
r AS (SELECT event_id, lat, lon, CASE WHEN event_id % 3 = 0 THEN 'SH1' ELSE 'NH65' END AS ref FROM p)
SELECT r.event_id AS route_id, arg_min(o.id, o.position) AS override_id FROM r LEFT JOIN o ON o.ref = r.ref AND lat BETWEEN a::double AND b::double AND lon BETWEEN c::double AND d::double GROUP BY 1""")
def route_bbox_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.createDataFrame([(0, "A", "nh 65", 17.0, 17.04, 78.0, 78.05), (1, "B", "NH65", 17.02, 17.1, 78.02, 78.1), (2, "C", "SH 1", 17.0, 17.1, 78.0, 78.1)], "position int, id string, highway_ref string, min_lat double, max_lat double, min_lon double, max_lon double")
    r = points(spark, sf_dir).select(F.col("event_id").alias("route_id"), "lat", "lon", F.when(F.col("event_id") % 3 == 0, "SH 1").otherwise("NH 65").alias("highway_ref"))
    return context.route_overrides(r, o).select("route_id", "override_id")


def ways(spark: SparkSession) -> DataFrame:
    """Twelve short two-point ways."""
    rows = [(k, "trunk", "NH 65", None, "yes" if k % 2 else "-1", [(17.0 + 0.008 * k, 78.0), (17.0 + 0.008 * k + 0.001, 78.1)]) for k in range(12)]
    return spark.createDataFrame(rows, "way_id int, highway string, ref string, name string, oneway string, geometry array<struct<lat:double,lon:double>>")


_WAY = "w AS (SELECT k AS way_id, 17.0::double + 0.008::double * k AS alat, 78.0::double AS alon, 17.0::double + 0.008::double * k + 0.001::double AS blat, 78.1::double AS blon FROM range(12) t(k))"


@query(f"""WITH {_POINTS}, {_WAY}, x AS (SELECT event_id, way_id, (alon - lon) * cos(radians(lat)) * radians(1) * 6371000 AS ax, (alat - lat) * radians(1) * 6371000 AS ay, (blon - lon) * cos(radians(lat)) * radians(1) * 6371000 AS bx, (blat - lat) * radians(1) * 6371000 AS by_ FROM p, w),
t AS (SELECT *, greatest(0, least(1, -(ax * (bx - ax) + ay * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))) AS s FROM x)
SELECT event_id AS point_id, round(min(sqrt(pow(ax + s * (bx - ax), 2) + pow(ay + s * (by_ - ay), 2))), 3) AS metres FROM t GROUP BY 1""")
def nearest_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select(F.col("event_id").alias("point_id"), "lat", "lon")
    return context.nearest_way(p, ways(spark)).select("point_id", F.round("metres", 3).alias("metres"))


_BEARING = "((degrees(atan2(sin(radians(blon - alon)) * cos(radians(blat)), cos(radians(alat)) * sin(radians(blat)) - sin(radians(alat)) * cos(radians(blat)) * cos(radians(blon - alon)))) + CASE WHEN way_id % 2 = 0 THEN 180 ELSE 0 END) % 360 + 360) % 360"


_LONG = "w AS (SELECT s_suppkey AS way_id, 17.0::double + (s_suppkey % 7) * 0.35::double AS alat, 77.0::double + (s_suppkey % 11) * 0.4::double AS alon, 17.0::double + (s_suppkey % 7) * 0.35::double + (s_suppkey % 3) * 1.5::double AS blat, 77.0::double + (s_suppkey % 11) * 0.4::double + (s_suppkey % 5) * 0.9::double AS blon FROM supplier)"


@query(f"""WITH {_POINTS}, {_LONG}, x AS (SELECT event_id, way_id, alat, alon, lat, lon, (alon - lon) * cos(radians(lat)) * radians(1) * 6371000 AS ax, (alat - lat) * radians(1) * 6371000 AS ay, (blon - lon) * cos(radians(lat)) * radians(1) * 6371000 AS bx, (blat - lat) * radians(1) * 6371000 AS by_, blat = alat AND blon = alon AS lone FROM p, w),
t AS (SELECT *, CASE WHEN lone THEN 0 ELSE greatest(0, least(1, -(ax * (bx - ax) + ay * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))) END AS s FROM x)
SELECT event_id AS point_id, round(min(sqrt(pow(ax + s * (bx - ax), 2) + pow(ay + s * (by_ - ay), 2))), 3) AS metres FROM t GROUP BY 1""")
def nearest_long_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A way for each supplier, up to some hundred kilometres long and seldom near the points."""
    k, lit = F.col("s_suppkey"), F.lit
    lat, lon = lit(17.0) + (k % 7) * lit(0.35), lit(77.0) + (k % 11) * lit(0.4)
    at = lambda y, x: F.struct(y.alias("lat"), x.alias("lon"))
    w = fx.load(spark, sf_dir, "supplier").select(k.alias("way_id"), F.array(at(lat, lon), at(lat + (k % 3) * lit(1.5), lon + (k % 5) * lit(0.9))).alias("geometry"))
    p = points(spark, sf_dir).select(F.col("event_id").alias("point_id"), "lat", "lon")
    return context.nearest_way(p, w).select("point_id", F.round("metres", 3).alias("metres"))


_PAIRED = "w AS (SELECT c_custkey AS way_id, c_nationkey AS road, CASE WHEN c_custkey % 3 = 0 THEN 180 ELSE 0 END AS turn, c_custkey % 5 < 3 AS one, 17.0::double + (c_custkey * 7 % 97) * 0.002::double AS alat, 78.0::double + (c_custkey * 11 % 89) * 0.002::double AS alon, 17.0::double + (c_custkey * 7 % 97) * 0.002::double + 0.001::double AS blat, 78.0::double + (c_custkey * 11 % 89) * 0.002::double + (c_custkey % 4) * 0.0005::double AS blon FROM customer)"
_COURSE = _BEARING.replace("CASE WHEN way_id % 2 = 0 THEN 180 ELSE 0 END", "turn")


@query(f"""WITH {_PAIRED}, h AS (SELECT way_id, road, {_COURSE} AS b, unnest([1, 2]) AS n, unnest([alat, blat]) AS lat, unnest([alon, blon]) AS lon FROM w WHERE one),
p AS (SELECT a.way_id, c.way_id AS other_id, min(round({_HAV.format(a="a.", b="c.")}, 6)) AS metres FROM h a JOIN h c ON a.road = c.road AND a.way_id <> c.way_id AND abs((a.b - c.b + 540) % 360 - 180) >= 120 GROUP BY 1, 2)
SELECT way_id, arg_min(other_id, struct_pack(m := metres, o := other_id)) AS other_id, round(min(metres), 3) AS metres FROM p WHERE metres <= 2000 GROUP BY 1""")
def opposite_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A way for each customer; the road is the nation's."""
    k, lit = F.col("c_custkey"), F.lit
    lat, lon = lit(17.0) + (k * 7 % 97) * lit(0.002), lit(78.0) + (k * 11 % 89) * lit(0.002)
    at = lambda y, x: F.struct(y.alias("lat"), x.alias("lon"))
    shape = F.array(at(lat, lon), at(lat + lit(0.001), lon + (k % 4) * lit(0.0005)))
    w = fx.load(spark, sf_dir, "customer").select(k.alias("way_id"), lit("trunk").alias("highway"), F.concat(lit("NH "), F.col("c_nationkey").cast("string")).alias("ref"), lit(None).cast("string").alias("name"), F.when(k % 5 >= 3, "no").when(k % 3 == 0, "-1").otherwise("yes").alias("oneway"), shape.alias("geometry"))
    return context.opposite_carriageways(w, 2000.0).withColumn("metres", F.round("metres", 3))


@query("""WITH s AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'unknown' WHEN c_custkey % 3 = 1 THEN c_mktsegment END AS setting, CASE WHEN c_custkey % 4 = 0 THEN (c_custkey % 6)::int END AS lanes FROM customer),
r AS (SELECT s_suppkey AS id, 'rural' AS setting, (s_nationkey)::int AS lanes FROM supplier)
SELECT coalesce(s.id, r.id) AS id, coalesce(nullif(s.setting, 'unknown'), r.setting) AS setting, coalesce(s.lanes, r.lanes) AS lanes FROM s FULL JOIN r ON s.id = r.id""")
def context_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    s = fx.load(spark, sf_dir, "customer").select(n.alias("id"), F.when(n % 3 == 0, "unknown").when(n % 3 == 1, F.col("c_mktsegment")).alias("setting"), F.when(n % 4 == 0, (n % 6).cast("int")).alias("lanes"))
    r = fx.load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("rural").alias("setting"), F.col("s_nationkey").alias("lanes"))
    return context.overlay(s, r, "id", ["setting", "lanes"])


# --- health, repair and context ------------------------------------------------------------------------------------


@query("""SELECT count(*) AS documents, sum(doc_id % 9)::bigint AS chunks, sum(doc_id % 4)::bigint AS low_text_pages, count(*) FILTER (doc_id % 17 = 0) AS failed,
 count(*) FILTER (doc_id % 5 = 0) AS unknown_identity, count(*) FILTER (doc_id % 11 = 0) AS stale_identity FROM documents""")
def manifest_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    m = fx.load(spark, sf_dir, "documents").select((n % 9).alias("chunks"), (n % 4).alias("low_text_pages"), (n % 17 == 0).alias("failed"), F.when(n % 5 != 0, "S").alias("standard_id"), F.when(n % 11 == 0, "old").otherwise(corpus.IDENTITY_VERSION).alias("identity_version"))
    return corpus.manifest_summary(m)


@query("""WITH c AS (SELECT doc_id AS chunk_id, doc_id // 3 AS doc, CASE WHEN doc_id // 3 % 4 = 0 THEN 'A' WHEN doc_id % 2 = 0 THEN 'B' END AS s, CASE WHEN doc_id % 7 > 0 THEN 1990 + doc_id // 3 % 5 END AS y FROM documents),
o AS (SELECT doc, CASE WHEN count(DISTINCT s) = 1 THEN min(s) END AS s1, CASE WHEN count(DISTINCT y) = 1 THEN min(y) END AS y1 FROM c GROUP BY 1),
n AS (SELECT doc, coalesce(CASE WHEN doc % 3 = 1 THEN 'A' END, s1) AS ns, coalesce(CASE WHEN doc % 3 = 2 THEN 2000 END, y1) AS ny FROM o)
SELECT chunk_id, ns AS standard_id, ny AS edition_year FROM c JOIN n USING (doc) WHERE s IS DISTINCT FROM ns OR y IS DISTINCT FROM ny""")
def metadata_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    doc = F.expr("doc_id div 3")
    chunks = fx.load(spark, sf_dir, "documents").select(n.alias("chunk_id"), doc.alias("document_sha256"), F.when(doc % 4 == 0, "A").when(n % 2 == 0, "B").alias("standard_id"), F.when(n % 7 > 0, 1990 + doc % 5).alias("edition_year"))
    d = F.col("document_sha256")
    new = chunks.select("document_sha256").distinct().select("document_sha256", F.when(d % 3 == 1, "A").alias("standard_id"), F.when(d % 3 == 2, F.lit(2000).cast("long")).alias("edition_year"))
    return corpus.repair_metadata(chunks, new).select("chunk_id", "standard_id", "edition_year")


@query("""SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 3 = 0 THEN 'road_class' END, CASE WHEN c_custkey % 4 = 0 THEN 'setting' END, CASE WHEN c_custkey % 5 <> 0 THEN 'lanes_total' END,
 CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 10 < 6 THEN 'verified_road_class' END) AS missing FROM customer""")
def missing_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    c = fx.load(spark, sf_dir, "customer").select("c_custkey", F.when(n % 3 != 0, F.col("c_mktsegment")).otherwise("unknown").alias("road_class"), F.when(n % 4 != 0, "rural").otherwise(" ").alias("setting"), F.when(n % 5 == 0, F.lit(2)).alias("lanes_total"), F.when(n % 10 > 0, (n % 10) / F.lit(9.0)).alias("confidence"))
    have = {f: F.col(f) for f in ("road_class", "setting", "lanes_total")}
    # 6 / 9 is above 0.65, 5 / 9 is not
    return c.select("c_custkey", F.array_join(context.missing_context(F.array(*map(F.lit, _LANE.required)), have, F.col("road_class"), F.col("confidence")), ",").alias("missing"))


@query("""WITH o AS (SELECT user_id, CASE WHEN event_id % 5 > 0 THEN event_id % 4 END AS lanes, event_id % 2 AS centre, 2 AS shoulder, CASE WHEN event_id % 9 = 0 THEN 40 + 10 * (event_id % 7) END AS speed FROM events),
l AS (SELECT user_id, lanes, row_number() OVER (PARTITION BY user_id ORDER BY lanes) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM o WHERE lanes > 0),
c AS (SELECT user_id, centre, row_number() OVER (PARTITION BY user_id ORDER BY centre) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM o),
s AS (SELECT user_id, speed, row_number() OVER (PARTITION BY user_id ORDER BY speed) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM o WHERE speed IS NOT NULL),
u AS (SELECT DISTINCT user_id FROM o),
j AS (SELECT u.user_id, l.lanes, c.centre, s.speed FROM u LEFT JOIN l ON l.user_id = u.user_id AND l.rn = l.n // 2 + 1 LEFT JOIN c ON c.user_id = u.user_id AND c.rn = c.n // 2 + 1 LEFT JOIN s ON s.user_id = u.user_id AND s.rn = s.n // 2 + 1)
SELECT user_id AS route_id, lanes::int AS lanes, CASE WHEN coalesce(lanes, 0) < 2 THEN 'unknown' WHEN centre >= lanes - 1 THEN 'undivided' WHEN centre = 0 THEN 'divided' ELSE 'unknown' END AS carriageway, speed::double AS posted_speed_kmph FROM j""")
def sheet_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    o = fx.load(spark, sf_dir, "events").select(
        F.col("user_id").alias("route_id"), F.when(n % 5 > 0, (n % 4).cast("string")).alias("Expected Total Lanes"), (n % 2).cast("string").alias("Centre Lanes Detected"), F.lit("2 seen").alias("Shoulder Lanes Detected"),
        F.when(n % 9 == 0, F.concat(F.lit("Speed limit "), (40 + 10 * (n % 7)).cast("string"))).otherwise("Chevron").alias("Traffic Sign Class"),
    )
    return context.from_sheet(o).select("route_id", "lanes", "carriageway", "posted_speed_kmph")


# the rest registers itself here
from specaudit.plans import more_queries  # noqa: E402, F401
