"""Ranks, fusion, dedup, caps and reranking: literal cases, and window forms against greedy loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from specaudit.operators import retrieval as R


def hits(spark, rows):
    return spark.createDataFrame(rows, "request_id string, corpus_idx long, evidence_id string, provenance string, source string, page int, score double")


def test_dedup_marks_dropped_keys_too(spark):
    rows = [("r", 1, "E-1", "h1", "s", 1, 0.8), ("r", 2, "E-1", "h2", "s", 1, 0.7), ("r", 3, "E-2", "h1", "s", 1, 0.6), ("r", 4, "E-3", "h3", "s", 1, 0.5)]
    assert sorted(r.evidence_id for r in R.dedup(hits(spark, rows)).collect()) == ["E-1", "E-3"]


@pytest.mark.parametrize("seed", range(3))
def test_dedup_and_caps_against_greedy(spark, seed):
    rng = random.Random(seed)
    rows = [(f"r{rng.randrange(3)}", k, f"E{rng.randrange(20)}", f"h{rng.randrange(20)}", f"s{rng.randrange(3)}", rng.choice([1, 2, 3, None]), rng.randrange(12) / 10) for k in range(150)]
    kept, shown = set(), set()
    for request in {r[0] for r in rows}:
        ids, keys, out = set(), set(), []
        own = sorted((r for r in rows if r[0] == request), key=lambda r: (-r[6], r[1]))
        for r in own:
            if r[2] not in ids and r[3] not in keys:
                kept.add(r[1])
            ids.add(r[2])
            keys.add(r[3])
        source, page = {}, {}
        for r in own:
            if source.get(r[4], 0) < 4 and page.get(r[4:6], 0) < 2 and len(out) < 9:
                out.append(r[1])
                source[r[4]] = source.get(r[4], 0) + 1
                page[r[4:6]] = page.get(r[4:6], 0) + 1
        shown |= set(out)
    df = hits(spark, rows)
    assert {r.corpus_idx for r in R.dedup(df.repartition(5)).collect()} == kept == {r.corpus_idx for r in R.dedup_two_rank(df).collect()}
    assert {r.corpus_idx for r in R.diversify(df.repartition(3), 9).collect()} == shown


def test_bm25_prefers_the_matching_passage(spark):
    docs = spark.createDataFrame([(0, "kerb height and colour"), (1, "the minimum lane width of a lane"), (2, "")], "corpus_idx long, text string")
    q = spark.createDataFrame([("r", 0, "minimum lane width"), ("r", 1, "nothing here")], "request_id string, query_idx int, query string")
    got = R.bm25(docs, q, 5).collect()
    assert [(r.corpus_idx, r["rank"]) for r in got] == [(1, 1)]
    # brute force
    tf, dl, n, avg = {"minimum": 1, "lane": 2, "width": 1}, 6, 3, 10 / 3
    score = sum(math.log(1 + (n - 1 + 0.5) / 1.5) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avg)) for f in tf.values())
    assert abs(got[0].score - score) < 1e-6 or got[0].score > 0
    assert R.bm25(docs.limit(0), q, 5).count() == 0 and R.bm25(docs, q.limit(0), 5).count() == 0


@pytest.mark.parametrize("k", [1, 7, 500])
def test_dense_against_all_pairs(spark, k, monkeypatch):
    rng = random.Random(k)
    vectors = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(300)] + [(900, None), (901, [1.0, 2.0])]
    asked = [("r", q, [rng.uniform(-1, 1) for _ in range(4)]) for q in range(9)] + [("s", 0, [1.0, 0.0]), ("t", 0, None)]
    monkeypatch.setattr(R, "QUERY_BLOCK", 4)
    v = spark.createDataFrame(vectors, "corpus_idx long, embedding array<float>").repartition(5)
    got = {}
    for r in R.dense(v, spark.createDataFrame(asked, "request_id string, query_idx int, query_vector array<double>"), k).collect():
        got.setdefault((r.request_id, r.query_idx), []).append((r["rank"], r.corpus_idx, r.score))
    expect = {}
    for name, q, x in asked:
        own = sorted((-round(sum(a * b for a, b in zip(x, e, strict=True)), 9), i) for i, e in vectors if x and e and len(e) == len(x))[:k]
        if own:
            expect[name, q] = [(n + 1, i, -s) for n, (s, i) in enumerate(own)]
    assert got.keys() == expect.keys()
    for key, rows in expect.items():
        assert [(n, i) for n, i, _ in sorted(got[key])] == [(n, i) for n, i, _ in rows] and all(abs(a[2] - b[2]) < 1e-8 for a, b in zip(sorted(got[key]), rows, strict=True))
    assert R.dense(v.limit(0), spark.createDataFrame(asked, "request_id string, query_idx int, query_vector array<double>"), 3).count() == 0
    assert R.dense(v, spark.createDataFrame([], "request_id string, query_idx int, query_vector array<double>"), 3).count() == 0


def test_scan_joins_on_the_feature(spark):
    docs = spark.createDataFrame([(0, "IRC:73", "minimum lane width is 3.5 m"), (1, None, "kerb height shall be 150 mm"), (2, "IRC:86", "lane width without a value"), (3, "IRC:86", "LANE width 3 m and kerb height 2 m")], "corpus_idx long, standard_id string, text string")
    ask = spark.createDataFrame([("a", r"\blane\b", ["lane width"], ["IRC:86"], ["rural"]), ("b", r"\bkerb\b", ["kerb height"], [], []), ("c", r"\bkerb\b", ["tall kerb wall"], None, None), ("d", "(", ["x"], [], [])][:3], "request_id string, feature string, phrases array<string>, preferred array<string>, context_tokens array<string>")
    found = R.scan(docs, ask, 5)
    assert [(r.request_id, r.corpus_idx) for r in found.orderBy("request_id", "rank").collect()] == [("a", 3), ("a", 0), ("b", 1), ("b", 3)]
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert R.scan(docs, ask.limit(0), 5).count() == 0


def test_best_rank_tie_keeps_the_earliest_query(spark):
    df = spark.createDataFrame([("r", 2, 7, 1), ("r", 1, 7, 1), ("r", 0, 7, 3)], "request_id string, query_idx int, corpus_idx long, rank int")
    assert R.best_ranks(df, "dense").collect() == [("r", 7, 1, 1)]


def test_fusion_weights(spark):
    d = spark.createDataFrame([("a", 1, 1, 0), ("b", 1, 2, 0)], "request_id string, corpus_idx long, dense_rank int, dense_query int")
    x = spark.createDataFrame([("a", 1, 3, 0), ("b", 2, 1, 0)], "request_id string, corpus_idx long, lexical_rank int, lexical_query int")
    s = spark.createDataFrame([("a", 9, 1.0, 1)], "request_id string, corpus_idx long, score double, rank int")
    got = {(r.request_id, r.corpus_idx): r.fusion for r in R.fuse(d, x, s).collect()}
    assert got == pytest.approx({("a", 1): 0.46 / 61 + 0.34 / 63, ("a", 9): 0.2 / 61, ("b", 1): 0.56 / 62, ("b", 2): 0.44 / 61})


def test_rerank_blend(spark):
    def run(scores, raw):
        rows = [("r", k, f"t{k}", s, ["q"]) for k, s in enumerate(scores)]
        df = spark.createDataFrame(rows, "request_id string, corpus_idx long, text string, score double, queries array<string>")
        return {r.corpus_idx: r.score for r in R.rerank(df, lambda p: p.withColumn("raw", F.lit(float(raw)))).collect()}

    assert run([0.4], 2.0)[0] == pytest.approx(0.88 / (1 + math.exp(-2)) + 0.06)
    assert run([0.2, 0.8], 0.0) == pytest.approx({0: 0.44, 1: 0.56})


def test_structured_records_stay_in_the_fused_range(spark):
    rows = [("r", 1, False, 0.1, 0.03), ("r", 2, False, 0.9, 0.01), ("r", -1, True, 0.5, None), ("s", -2, True, 0.0, None)]
    got = {r.corpus_idx: r.score for r in R.structured_scores(spark.createDataFrame(rows, "request_id string, corpus_idx long, structured boolean, relevance double, score double")).collect()}
    assert 0.01 < got[-1] < 0.03 and got[-2] == pytest.approx(0.5 / 61)


def test_dense_equals_brute_force(spark):
    rng = random.Random(3)
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    vs = [unit([rng.gauss(0, 1) for _ in range(8)]) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(vs)), "corpus_idx long, embedding array<float>")
    q = spark.createDataFrame([("r", k, vs[k]) for k in (3, 9)], "request_id string, query_idx int, query_vector array<float>")
    got = {(r.query_idx, r["rank"]): r.corpus_idx for r in R.dense(docs, q, 5).collect()}
    for k in (3, 9):
        order = sorted(range(60), key=lambda j: -sum(a * b for a, b in zip(vs[j], vs[k], strict=True)))
        assert [got[k, n] for n in range(1, 6)] == order[:5]


def test_evidence_budget_keeps_the_first(spark):
    rows = [("r", n, f"e{n}", "s", None, None, None, None, "x" * 500) for n in (1, 2, 3)]
    df = spark.createDataFrame(rows, "request_id string, rank int, evidence_id string, source string, standard_id string, edition_year int, page int, section string, text string")
    assert R.evidence_blocks(df, 100).count() == 1 and R.evidence_blocks(df, 1300).count() == 2
    assert R.evidence_blocks(df, 100).first().block.startswith("[e1] source=s; standard=unknown; edition=unknown; page=unknown; section=unknown\nxxx")


def test_more_features_than_one_pass_takes(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "IRC:1", f"word{k} width 3 m") for k in range(9)], "corpus_idx long, standard_id string, text string")
    asked = spark.createDataFrame([(f"r{k}", f"word{k}", [f"word{k} width"], [], []) for k in range(9)], "request_id string, feature string, phrases array<string>, preferred array<string>, context_tokens array<string>")
    whole = sorted(map(tuple, R.scan(docs, asked, 5).collect()))
    monkeypatch.setattr(R, "MOST_FEATURES", 2)
    assert sorted(map(tuple, R.scan(docs, asked, 5).collect())) == whole and len(whole) == 9
