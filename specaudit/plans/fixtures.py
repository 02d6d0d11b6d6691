"""Domain rows derived from the driver's tables, alike in Spark and in DuckDB.

The tables carry no standards text, so passages get one clause each and events become observation cells.
Attributes come from arithmetic on ids; no row is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STANDARDS = ("IRC:73", "IRC:SP:73", "IRC:86", "IRC:SP:84", "IRC:SP:87", "IRC:SP:99", "IRC:67", "IRC:119")
AUDITED = ("min_lane_width", "min_sign_height", "min_kerb_height", "min_w_beam_barrier_height", "min_concrete_barrier_height", "min_radius_curvature")
#: metric, status, value, second value, comparator
RULES = (("min_lane_width", "found", 3.5, None, ">="), ("min_sign_height", "found", 2.1, None, ">="), ("min_kerb_height", "found", 0.15, None, "="), ("min_w_beam_barrier_height", "found", 0.705, 5.5, "range"), ("min_concrete_barrier_height", "needs_context", 0.9, None, ">="), ("min_radius_curvature", "found", 4.25, None, "<="))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LIST = "[" + ", ".join(f"'{s}'" for s in STANDARDS) + "]"
_CLAUSE = """CASE doc_id % 5
  WHEN 0 THEN concat(' The minimum traffic lane width shall be ', cast(2500 + (doc_id % 20) * 100 AS {s}), ' mm.')
  WHEN 1 THEN concat(' 4.', cast(doc_id % 9 AS {s}), ' Kerbs. The kerb height shall be ', cast(100 + doc_id % 300 AS {s}), ' mm above 2 km.')
  WHEN 2 THEN concat(' The W beam rail stands at ', cast(700 + doc_id % 60 AS {s}), ' +/- ', cast(5 + doc_id % 30 AS {s}), ' mm above ground.')
  WHEN 3 THEN concat(' The radius of a horizontal curve is at least ', cast(100 + doc_id % 800 AS {s}), ' m at 80 km/h.')
  ELSE concat(' A toll lane width of 1,', cast(100 + doc_id % 900 AS {s}), ' mm or more than 3.5 m is usual.') END"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages: ``corpus_idx, source, source_path, chunk_index, page, standard_id, edition_year, content_hash, text``."""
    d = load(spark, sf_dir, "documents")
    ids = F.array(*map(F.lit, STANDARDS))
    return d.select(
        F.col("doc_id").alias("corpus_idx"), "source", F.col("source").alias("source_path"), F.expr("doc_id div 20").alias("chunk_index"), F.expr("doc_id div 60 + 1").alias("page"),
        F.get(ids, (F.col("doc_id") % 8).cast("int")).alias("standard_id"), (1990 + 10 * (F.col("doc_id") % 4)).alias("edition_year"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), F.concat(F.coalesce("text", F.lit("")), F.expr(_CLAUSE.format(s="string"))).alias("text"),
    )


CHUNKS = f"""chunk_v AS (SELECT doc_id AS corpus_idx, source, source AS source_path, doc_id // 20 AS chunk_index, doc_id // 60 + 1 AS page,
  {_LIST}[doc_id % 8 + 1] AS standard_id, 1990 + 10 * (doc_id % 4) AS edition_year, sha256(coalesce(text, '')) AS content_hash,
  coalesce(text, '') || {_CLAUSE.format(s="varchar")} AS text FROM documents)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells: ``event_id, route_id, metric_key, cell, label, ts``; a seventh of the cells is empty, some hold two values."""
    e = load(spark, sf_dir, "events")
    keys = F.array(*map(F.lit, AUDITED))
    cell = F.expr("CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 3 = 0 THEN concat(cast(event_id % 6 AS string), '.', lpad(cast(event_id * 37 % 100 AS string), 2, '0'), ', ', cast(event_id % 5 AS string), '.15') ELSE concat(cast(event_id % 6 AS string), '.', lpad(cast(event_id * 37 % 100 AS string), 2, '0')) END")
    label = F.expr("CASE WHEN event_id % 11 = 0 THEN 'no fix' ELSE concat('N: ', cast(10 + event_id % 90 AS string), '.', lpad(cast(event_id % 9973 AS string), 4, '0'), ' E: ', cast(60 + event_id % 40 AS string), '. ', lpad(cast(event_id * 7 % 9973 AS string), 4, '0')) END")
    return e.select("event_id", F.col("user_id").alias("route_id"), F.get(keys, (F.col("event_id") % 6).cast("int")).alias("metric_key"), cell.alias("cell"), label.alias("label"), "ts")


_KEYS = "[" + ", ".join(f"'{s}'" for s in AUDITED) + "]"
OBSERVATIONS = f"""obs_v AS (SELECT event_id, user_id AS route_id, {_KEYS}[event_id % 6 + 1] AS metric_key,
  CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 3 = 0 THEN (event_id % 6)::varchar || '.' || lpad((event_id * 37 % 100)::varchar, 2, '0') || ', ' || (event_id % 5)::varchar || '.15'
       ELSE (event_id % 6)::varchar || '.' || lpad((event_id * 37 % 100)::varchar, 2, '0') END AS cell,
  CASE WHEN event_id % 11 = 0 THEN 'no fix' ELSE 'N: ' || (10 + event_id % 90)::varchar || '.' || lpad((event_id % 9973)::varchar, 4, '0') || ' E: ' || (60 + event_id % 40)::varchar || '. ' || lpad((event_id * 7 % 9973)::varchar, 4, '0') END AS label, ts
  FROM events)"""


def rules(spark: SparkSession) -> DataFrame:
    """Six literal rules."""
    rows = [(k, s, a, b, c, False, None, f"{k} source, p. 1", "stated") for k, s, a, b, c in RULES]
    return spark.createDataFrame(rows, "metric_key string, status string, value_m double, second_value_m double, comparator string, provisional boolean, basis string, label string, reason string")


def _sql(v) -> str:
    return "NULL::double" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::double"


RULES_SQL = "rule_v AS (SELECT * FROM (VALUES " + ", ".join(f"({', '.join(map(_sql, r))})" for r in RULES) + ") t(metric_key, status, value_m, second_value_m, comparator))"
VALUES = "val_v AS (SELECT o.*, list_transform(regexp_extract_all(cell, '[-+]?\\d+(?:\\.\\d+)?'), lambda x: x::double) AS vals FROM obs_v o)"
#: One row a value with its state.
STATES = f"""{OBSERVATIONS}, {RULES_SQL}, {VALUES},
each_v AS (SELECT v.event_id, v.route_id, v.metric_key, v.label, u.x, r.status, r.comparator,
  CASE comparator WHEN '>=' THEN x >= value_m WHEN '<=' THEN x <= value_m WHEN '=' THEN abs(x - value_m) <= greatest(1e-6, abs(value_m) * 1e-6) ELSE x BETWEEN value_m AND second_value_m END AS ok
  FROM val_v v JOIN rule_v r USING (metric_key), unnest(v.vals) AS u(x)),
state_v AS (SELECT *, CASE WHEN status <> 'found' THEN 'REVIEW_REQUIRED' WHEN ok THEN 'PASS' WHEN comparator = '=' THEN 'REVIEW_REQUIRED' ELSE 'FAIL' END AS state FROM each_v),
row_v AS (SELECT v.event_id, v.route_id, v.metric_key, v.label, count(s.event_id) AS n,
  count(*) FILTER (s.state = 'FAIL') AS failures, count(*) FILTER (s.state = 'REVIEW_REQUIRED') AS reviews
  FROM val_v v LEFT JOIN state_v s ON s.event_id = v.event_id GROUP BY ALL)"""


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored cases from the labels."""
    x = load(spark, sf_dir, "labels")
    flag = lambda n, m: F.when(F.col("doc_id") % n != 0, F.col("doc_id") % m != 0)
    rank = F.when(F.col("doc_id") % 13 != 0, (F.col("doc_id") % 12 + 1).cast("int"))
    return x.select(
        F.col("doc_id").alias("case_id"), F.concat(F.lit("metric "), (F.col("doc_id") % 8).cast("string")).alias("metric_key"), rank.alias("first_rank"),
        flag(5, 7).alias("citation_match"), flag(3, 11).alias("standard_match"), flag(4, 9).alias("edition_match"), flag(7, 3).alias("value_match"), flag(6, 5).alias("comparator_match"),
        flag(9, 2).alias("applicability_match"), flag(8, 4).alias("audit_decision_match"), (F.col("toxic") == 1).alias("expected_abstention"), (F.col("quality") == 0).alias("predicted_abstention"),
    )


def _flag(n: int, m: int, name: str) -> str:
    return f"CASE WHEN doc_id % {n} <> 0 THEN doc_id % {m} <> 0 END AS {name}"


GOLD = f"""gold_v AS (SELECT doc_id AS case_id, CASE WHEN doc_id % 13 <> 0 THEN doc_id % 12 + 1 END AS first_rank,
  {_flag(5, 7, "citation_match")}, {_flag(3, 11, "standard_match")}, {_flag(4, 9, "edition_match")}, {_flag(7, 3, "value_match")}, {_flag(6, 5, "comparator_match")},
  {_flag(9, 2, "applicability_match")}, {_flag(8, 4, "audit_decision_match")}, toxic = 1 AS expected_abstention, quality = 0 AS predicted_abstention FROM labels)"""
