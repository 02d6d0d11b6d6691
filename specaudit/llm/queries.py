"""One thin query for each operator, with production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from specaudit.llm.token_file import token_file_digest

    return token_file_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from specaudit.llm.simhash import simhash_query

    return simhash_query(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from specaudit.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from specaudit.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from specaudit.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"))


def op3_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from specaudit.llm.chat import repair

    return repair(table(spark, sf_dir, "conversations"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from specaudit.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from specaudit.llm.line_dedup import drop_boilerplate

    cleaned = drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return cleaned.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("text_sha256"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from specaudit.llm.decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", *(F.round(c, 9).alias(c) for c in ("score", "overlap", "question_overlap", "answer_overlap")))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from specaudit.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from specaudit.llm.resampling import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from specaudit.llm.mixing import mixed

    return mixed(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from specaudit.llm.periodic import periodic_runs, run_digest

    return run_digest(periodic_runs(table(spark, sf_dir, "documents"), planted=True))


QUERIES = {f.__name__: f for f in (op1_token_file, op2_quality, op3_chat_repair, op4_personal_data, op5_line_dedup, op6_simhash, op7_decontamination, op8_exact_dedup, op9_language, op10_packing, op11_resampling, op12_mixing, op13_periodic_runs)}


def _repair_sql() -> str:
    """The dynamic program as a recursion over turns: a conversation's row holds the best way to each state, as its cost and a code of three digits a turn."""
    from specaudit.llm import chat

    def cell(r: int, s: int, t: int) -> str:
        step = chat.STEPS[r].get((s, t))
        return "{'cost': NULL::bigint, 'code': ''}" if step is None else f"{{'cost': {step[0]}::bigint, 'code': '{step[1]}{len(step[2])}{t}'}}"

    def table(of) -> str:
        return "[" + ", ".join("[" + ", ".join(of(s, t) for t in (1, 2, 3)) + "]" for s in range(4)) + "]"

    def fill(s: int, t: int) -> str:
        return "'" + ",".join(chat.ROLES[x - 1] for x in chat.FILL[s, t] or ()) + "'"

    def opened(states) -> str:
        return " || ".join(["''", *(f"'<|{chat.ROLES[x - 1]}|>' || chr(10) || '<|end|>' || chr(10)" for x in states)])

    steps = "[" + ", ".join(table(lambda s, t, r=r: cell(r, s, t)) for r in range(4)) + "]"
    closing = "[" + ", ".join(str(round(chat.UNIT * chat.COSTS["insert"]) * len(chat.CLOSE[s])) for s in range(4)) + "]"
    ends = "[" + ", ".join(opened(chat.CLOSE[s]) for s in range(4)) + "]"
    return f"""
WITH RECURSIVE m AS (SELECT {steps} AS m, {closing} AS closing, {ends} AS ends, {table(fill)} AS fills, {table(lambda s, t: opened(chat.FILL[s, t] or ()))} AS shown),
t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, CASE lower(trim(role)) WHEN 'system' THEN 0 WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS r,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, coalesce(text, '')) - 1 AS pos FROM conversations),
w AS (SELECT DISTINCT conv_id, -1::bigint AS pos, [{{'cost': 0::bigint, 'code': '', 's': 0}}] AS ways FROM t UNION ALL
  SELECT w.conv_id, t.pos, list_filter(list_transform([1, 2, 3], lambda x: list_min(list_transform(list_filter(w.ways, lambda y: m.m[t.r + 1][y.s + 1][x].cost IS NOT NULL),
    lambda y: {{'cost': y.cost + m.m[t.r + 1][y.s + 1][x].cost, 'code': y.code || m.m[t.r + 1][y.s + 1][x].code, 's': x}}))), lambda z: z IS NOT NULL)
  FROM w JOIN t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.pos = w.pos + 1, m),
e AS (SELECT conv_id, pos, list_min(list_transform(ways, lambda y: {{'cost': y.cost + closing[y.s + 1], 'code': y.code, 's': y.s}})) AS best FROM w, m QUALIFY pos = max(pos) OVER (PARTITION BY conv_id)),
d AS (SELECT t.conv_id, t.pos, t.turn, t.role, t.text, t.pos = e.pos AS last, substr(best.code, 3 * t.pos + 1, 1)::int AS a, substr(best.code, 3 * t.pos + 2, 1) <> '0' AS filled, substr(best.code, 3 * t.pos + 3, 1)::int AS s,
             CASE WHEN t.pos > 0 THEN substr(best.code, 3 * t.pos, 1)::int ELSE 0 END AS prev FROM t JOIN e ON e.conv_id IS NOT DISTINCT FROM t.conv_id),
n AS (SELECT d.*, ['system', 'user', 'assistant'][s] AS name, a IN (0, 2) AS new FROM d)
SELECT conv_id, pos, turn, role, name AS new_role, ['keep', 'merge', 'relabel', 'relabel+merge'][a + 1] AS action, CASE WHEN filled THEN fills[prev + 1][s] ELSE '' END AS inserted,
  CASE WHEN pos = 0 THEN '' WHEN new THEN '<|end|>' || chr(10) ELSE chr(10) END || CASE WHEN filled THEN shown[prev + 1][s] ELSE '' END || CASE WHEN new THEN '<|' || name || '|>' || chr(10) ELSE '' END || text
  || CASE WHEN last THEN '<|end|>' || chr(10) || ends[s + 1] ELSE '' END AS piece FROM n, m
"""


def _contamination_sql() -> str:
    """Every passage scored against every item that shares a word with it, then all shingles compared."""
    from specaudit.llm import decontaminate as d

    def words(c: str) -> str:
        return rf"regexp_extract_all(lower({c}), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+')"

    def shingles(c: str) -> str:
        return f"CASE WHEN len({c}) = 0 THEN [] ELSE list_distinct(list_transform(range(greatest(1, len({c}) - {d.SHINGLE - 1})), lambda k: array_to_string({c}[k + 1 : k + {d.SHINGLE}], ' '))) END"

    def share(c: str) -> str:
        return f"CASE len({c}) WHEN 0 THEN 0 WHEN 1 THEN contains(line, ' ' || {c}[1] || ' ')::int ELSE len(list_intersect({c}, held))::double / len({c}) END"

    return rf"""
WITH i AS (SELECT row_number() OVER () AS iid, item_id, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS text, {words("coalesce(text, '')")} AS ws FROM benchmark),
c AS (SELECT *, len(ws) AS n, CASE WHEN (len(ws) - 1) // {d.LEAST_STRIDE} = 0 THEN 0 ELSE floor(log2((len(ws) - 1) // {d.LEAST_STRIDE})) + 1 END AS klass, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {words("x")}), lambda x: len(x) > 0) AS parts FROM i WHERE len(ws) > 0),
p AS (SELECT *, greatest({d.LEAST_STRIDE}, max(n) OVER (PARTITION BY klass)) AS stride, CASE WHEN len(parts) < 2 THEN ws ELSE flatten(parts[: len(parts) - 1]) END AS q, CASE WHEN len(parts) < 2 THEN [] ELSE parts[len(parts)] END AS a FROM c),
s AS (SELECT iid, item_id, klass, {shingles("ws")} AS sw, {shingles("q")} AS sq, {shingles("a")} AS sa FROM p),
f AS (SELECT iid, n, klass, w, count(*) AS f FROM (SELECT iid, n, klass, unnest(ws) AS w FROM p) GROUP BY ALL), g AS (SELECT w, count(*) AS df FROM f GROUP BY 1), t AS (SELECT count(*) AS total, avg(n) AS mean FROM p),
x AS (SELECT iid, klass, w, ln(1 + (total - df + 0.5::double) / (df + 0.5::double)) * f * {d.K1 + 1}::double / (f + {d.K1}::double * ({1 - d.B}::double + {d.B}::double * n / greatest(1, mean))) AS x FROM f JOIN g USING (w), t),
y AS (SELECT iid, klass, w, x / sum(x) OVER (PARTITION BY iid) AS x FROM x),
o AS (SELECT row_number() OVER () AS rid, doc_id, {words("coalesce(text, '')")} AS ws FROM documents),
k AS (SELECT DISTINCT klass, stride FROM p), v AS (SELECT DISTINCT klass, w FROM y),
u AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS k FROM o),
z AS (SELECT DISTINCT rid, klass, stride, u.k // stride - back AS p, w FROM u JOIN v USING (w) JOIN k USING (klass), (VALUES (0), (1)) b(back) WHERE u.k // stride >= back),
h AS (SELECT rid, iid, z.klass, stride, p, sum(x) AS score FROM z JOIN y ON y.klass = z.klass AND y.w = z.w GROUP BY ALL HAVING sum(x) >= {d.THRESHOLD}::double),
l AS (SELECT h.*, doc_id, ws[p * stride + 1 : (p + 2) * stride] AS own FROM h JOIN o USING (rid)),
n AS (SELECT l.*, item_id, sw, sq, sa, ' ' || array_to_string(own, ' ') || ' ' AS line, {shingles("own")} AS held FROM l JOIN s USING (iid)),
r AS (SELECT rid, iid, doc_id, item_id, score, {share("sw")} AS whole, {share("sq")} AS q, {share("sa")} AS a FROM n),
best AS (SELECT doc_id, item_id, max(struct_pack(w := whole::double, q := q::double, a := a::double, s := score)) AS b FROM r WHERE whole >= {d.OVERLAP}::double OR (q >= {d.OVERLAP}::double AND a >= {d.ANSWER_OVERLAP}::double) GROUP BY rid, iid, doc_id, item_id)
SELECT doc_id, item_id, round(b.s, 9) AS score, round(b.w, 9) AS overlap, round(b.q, 9) AS question_overlap, round(b.a, 9) AS answer_overlap FROM best
"""


#: DuckDB SQL where it can express a query.
ORACLE_SQL: dict[str, str] = {
    "op8_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents),
g AS (SELECT h, count(*) AS group_size, arg_min(doc_id, struct_pack(a := -n_cp, b := doc_id)) AS keep_id FROM n GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, n.h AS text_sha256 FROM n JOIN g ON n.h = g.h
""",
    "op5_line_dedup": r"""
WITH p AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('h' || source, '-') AS host, coalesce(text, '') AS text FROM documents),
l AS (SELECT rid, doc_id, host, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM p),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
b AS (SELECT host, trim(line, ' ') AS line, count(DISTINCT rid) AS n FROM l WHERE trim(line, ' ') <> '' GROUP BY ALL),
x AS (SELECT b.host, b.line FROM b JOIN t USING (host) WHERE n >= 3 AND n > 0.05::DOUBLE * pages),
m AS (SELECT l.*, x.line IS NOT NULL AS gone FROM l LEFT JOIN x ON x.host = l.host AND x.line = trim(l.line, ' ')),
r AS (SELECT rid, doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '') AS text FROM m GROUP BY rid, doc_id)
SELECT doc_id, n_lines, n_dropped, sha256(text) AS text_sha256 FROM r
""",
    "op3_chat_repair": _repair_sql(),
    "op11_resampling": r"""
WITH m AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
w AS (SELECT kind, rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
      FROM (SELECT 0 AS kind, row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, coalesce(text, '') FROM benchmark)),
e AS (SELECT kind, rid, unnest(ws || list_transform(range(len(ws) - 1), lambda k: ws[k + 1] || ' ' || ws[k + 2])) AS f FROM w),
n AS (SELECT kind, rid, f, count(*) AS n FROM e GROUP BY ALL),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM n)),
b AS (SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::BIGINT)), lambda c, y: xor(c >> 8, crc[(xor(c, y) & 255) + 1]))) % 10000 AS bucket FROM h, m),
c AS (SELECT bucket, sum(n) FILTER (kind = 0) AS s, sum(n) FILTER (kind = 1) AS t FROM n JOIN b USING (f) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((sum(s) OVER ()) + 10000)::double / ((coalesce(s, 0) + 1)::double * (coalesce(sum(t) OVER (), 0) + 10000)::double)))::bigint AS gain FROM c),
d AS (SELECT rid, sum(n)::bigint AS n_features, floor(sum(n * gain)::double / sum(n))::bigint AS weight FROM n JOIN b USING (f) JOIN g USING (bucket) WHERE kind = 0 GROUP BY 1),
o AS (SELECT rid, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(ws) AS n_words, ('0x' || substr(sha256('7:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint AS h FROM w LEFT JOIN d USING (rid) WHERE kind = 0),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint AS score FROM o),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS total FROM z WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * total // 100 THEN rank END AS rank FROM z LEFT JOIN r USING (rid)
""",
    "op12_mixing": r"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, sha256('12:' || coalesce(doc_id::varchar, '')) AS place FROM documents),
g AS (SELECT source, sum(size)::bigint AS source_size FROM s GROUP BY 1),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM g),
r AS (SELECT *, 1.5::double * sum(source_size) OVER () AS want, 2 * source_size / weight::double AS ratio, coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight::double, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
             sum(weight) OVER (ORDER BY 2 * source_size / weight::double, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w),
l AS (SELECT coalesce(arg_min((want - capped) / free, ratio) FILTER (2 * source_size > (want - capped) / free * weight), 0) AS level FROM r),
t AS (SELECT source, source_size, CASE WHEN 2 * source_size <= level * weight THEN 2 * source_size ELSE level * weight END::double AS target FROM r, l),
q AS (SELECT *, least(2 * source_size, round(target)::bigint) AS quota FROM t),
p AS (SELECT s.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM s)
SELECT doc_id, size, source_size, target, (greatest(0, least(a + size, quota) - a) + greatest(0, least(a + source_size + size, quota) - a - source_size))::bigint AS taken FROM p JOIN q ON p.source IS NOT DISTINCT FROM q.source
""",
    "op7_decontamination": _contamination_sql(),
}
