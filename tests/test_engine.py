"""The engine end to end on a small corpus, its sources and sinks, and the streams against the batch."""

import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from specaudit.operators import audit
from specaudit.plans import settings
from specaudit.plans.engine import CONTEXT, Engine
from specaudit.sources import readers, sinks
from specaudit.sources.versions import Store
from specaudit.streaming import incremental

LANE = "4.2 Lanes\nThe minimum traffic lane width shall be 3.5 m on divided National Highway carriageway sections in rural areas."
KERB = "5.1 Kerbs\nThe kerb height shall be 150 mm for the raised median kerb of all urban streets in this standard."
FILL = "General words about the preparation of project reports and their annexures for the works of this manual."


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    folder = tmp_path_factory.mktemp("in")
    (folder / "manual.txt").write_text(f"IRC:SP:84-2019 Manual\n\n{FILL}\f{LANE}\n\n{FILL}")
    (folder / "urban.txt").write_text(f"IRC:86-2018 Urban roads\n\n{FILL}\f{KERB}")
    (folder / "copy.txt").write_text(f"IRC:86-2018 Urban roads\n\n{FILL}\f{KERB}")
    return str(folder)


@pytest.fixture(scope="module")
def engine(spark, corpus, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("index"))
    e = Engine(spark, f"{out}/index", settings.Settings(require_verified=False))
    e.index(readers.text_pages(spark, corpus))
    return e


def contexts(spark):
    rows = [{"request_id": "c1", "road_class": "National Highway", "road_class_confidence": 0.92, "setting": "rural", "terrain": "plain", "carriageway": "divided", "lanes_total": 4, "total_road_lanes": 4, "lanes_per_carriageway": 2, "kerb_type": "raised", "barrier_type": "w_beam"}, {"request_id": "c2", "setting": "rural", "road_class": "National Highway", "road_class_confidence": 0.4}]
    kinds = spark.createDataFrame([], CONTEXT).schema
    return spark.createDataFrame([tuple(r.get(n) for n in kinds.names) for r in rows], kinds)


def test_index_is_incremental(spark, corpus, engine):
    m = engine.manifest()
    got = {os.path.basename(r.source_path): (r.standard_id, r.edition_year, r.chunks) for r in m.collect()}
    assert got == {"manual.txt": ("IRC:SP:84", 2019, 2), "copy.txt": ("IRC:86", 2018, 2)}  # equal content counts once
    again = engine.index(readers.text_pages(spark, corpus))
    assert again.count() == 2 and engine.corpus().count() == 4
    assert {r.ok for r in engine.health().collect()} == {True}


def test_retrieve_rules_audit_evaluate(spark, engine):
    asked = engine.requests(contexts(spark), ["min_lane_width", "min_kerb_height"])
    hits = engine.retrieve(asked, "audit").cache()
    top = {r.request_id: r for r in hits.where("rank = 1").collect()}
    assert "lane width" in top["c1|min_lane_width"].text and top["c1|min_lane_width"].standard_id == "IRC:SP:84"
    assert hits.groupBy("request_id", "source", "page").count().where("count > 2").count() == 0
    ruled = {r.request_id: r for r in engine.rules(asked, hits).collect()}
    lane = ruled["c1|min_lane_width"]
    assert (lane.status, lane.value_m, lane.comparator, lane.provisional) == ("found", 3.5, ">=", True) and lane.citation.standard_id == "IRC:SP:84" and lane.citation.page == 2
    assert (ruled["c1|min_kerb_height"].status, ruled["c1|min_kerb_height"].value_m) == ("found", 0.15)
    assert ruled["c2|min_lane_width"].status == "needs_context" and "lanes_total" in ruled["c2|min_lane_width"].missing_context
    rule_rows = engine.rules(asked, hits).where("context_id = 'c1'").withColumn("route_id", F.lit("c1"))
    sheet = spark.createDataFrame([("c1", "1", "N: 17.1 E: 78.2", "2", "1", "2", "3.6, 3.4")], "route_id string, `Timestamp (sec)` string, `Raw OCR Text` string, `Expected Total Lanes` string, `Centre Lanes Detected` string, `Shoulder Lanes Detected` string, `Tracked Lane Widths (m)` string")
    row = engine.audit(sheet, rule_rows, contexts(spark).withColumn("route_id", F.col("request_id"))).first()
    assert row.Overall_Severity == "LOW SEVERITY" and "Lane 2: widen by 0.1 m" in row.Professional_Suggestions and "PROVISIONAL" in row.Lane_Width_Status
    kinds = spark.createDataFrame([], readers.GOLD).schema
    case = {"case_id": "c1", "metric_key": "min_lane_width", "expected_status": "found", "expected_value_m": 3.5, "expected_comparator": ">=", "expected_quote": "minimum traffic lane width shall be 3.5 m", "expected_standard_id": "irc:sp:84", "expected_edition_year": 2019, "expected_page": 2}
    s = engine.evaluate(spark.createDataFrame([tuple(case.get(n) for n in kinds.names)], kinds), contexts(spark)).first()
    assert (s.recall_at_5, s.mrr, s.value_accuracy, s.standard_accuracy, s.overall_correct) == (1.0, 1.0, 1.0, 1.0, 1.0)
    hits.unpersist()


def test_strict_mode_abstains_and_a_model_never_decides(spark, engine):
    strict = Engine(spark, engine.index_path, settings.Settings())
    asked = strict.requests(contexts(spark), ["min_lane_width"])
    hits = strict.retrieve(asked)
    got = {r.request_id: r for r in strict.rules(asked, hits).collect()}["c1|min_lane_width"]
    assert got.status == "ambiguous" and got.value_m == 3.5 and "unverified source" in got.reason
    asked = strict.requests(contexts(spark), ["min_concrete_barrier_height"])
    lies = lambda metric, ctx, evidence: {"status": "found", "evidence_id": "E-x", "quote": "9 m", "raw_value": 9.0, "raw_unit": "m", "comparator": ">="}
    strict.model = lies
    got = {r.request_id: r for r in strict.rules(asked, strict.retrieve(asked, "fast")).collect()}["c1|min_concrete_barrier_height"]
    assert got.status in ("invalid_evidence", "not_found") and got.value_m is None


def test_dense_structured_and_rerank(spark, engine):
    sha = engine.manifest().where("standard_id = 'IRC:86'").first().document_sha256
    records = readers._frame(spark, [{"evidence_id": "S-1", "metric_key": "min_kerb_height", "standard_id": "IRC:86", "edition_year": 2018, "source": "copy.txt", "source_sha256": sha, "page": 9, "section": "Fig. 1", "text": "kerb height figure 150 mm"}, {"evidence_id": "S-2", "metric_key": "min_kerb_height", "source_sha256": "gone", "text": "kerb"}], readers.RECORD)
    embed = lambda texts: [[float("kerb" in t.lower()), float("lane" in t.lower()), 0.1] for t in texts]
    e = Engine(spark, engine.index_path, settings.Settings(rerank=True), records=records, score_pairs=lambda p: p.withColumn("raw", F.when(F.col("text").contains("figure"), 3.0).otherwise(-1.0)))
    asked = e.requests(contexts(spark), ["min_kerb_height"])
    got = e.retrieve(asked).where("request_id = 'c1|min_kerb_height'").orderBy("rank").collect()
    assert got[0].evidence_id == "S-1" and "S-2" not in {r.evidence_id for r in got}
    docs = readers.embeddings(engine.corpus(), embed)
    assert docs.select(F.size("embedding")).distinct().collect() == [(3,)]


def test_prune_and_repair(spark, engine, corpus):
    ids = engine.corpus().select("document_sha256").distinct().withColumn("standard_id", F.lit("IRC:1")).withColumn("edition_year", F.lit(2001))
    copy = Engine(spark, engine.index_path + "-2")
    copy.index(readers.text_pages(spark, corpus))
    assert {r.standard_id for r in copy.repair_identity(ids).collect()} == {"IRC:1"}
    left = copy.prune(spark.createDataFrame([], "source_path string"), [os.path.dirname(copy.manifest().first().source_path)])
    assert left.count() == 0 and copy.store.read("chunks").count() == 0 and copy.store.snapshot().numbers["passages"] == 0


def test_only_touched_buckets_are_written(spark, tmp_path):
    pages = spark.createDataFrame([(f"/in/{k}.txt", f"sha{k}", 1, f"{FILL} Number {k}.", "text") for k in range(12)], "source_path string, document_sha256 string, page int, text string, parser string")
    e = Engine(spark, f"{tmp_path}/index")
    e.index(pages)
    first = e.store.snapshot()
    changed = pages.where("source_path = '/in/3.txt'").withColumn("document_sha256", F.lit("new")).withColumn("text", F.lit(LANE))
    e.index(changed)
    second = e.store.snapshot()
    for name in ("chunks", "manifest"):
        a, b = first.tables[name]["parts"], second.tables[name]["parts"]
        assert len([k for k in b if a.get(k) != b[k]]) == 1 and len(b) > 3
    assert second.numbers["passages"] == e.corpus().count() == 12
    assert e.corpus().where("source_path = '/in/3.txt'").first().text.endswith("rural areas.")
    assert e.index(pages.where("source_path = '/in/3.txt'").limit(0)).count() == 12 and e.store.snapshot().number == 2
    e.repair_identity(spark.createDataFrame([("sha5", "IRC:5", 1999)], "document_sha256 string, standard_id string, edition_year int"))
    third = e.store.snapshot().tables["chunks"]["parts"]
    assert len([k for k in third if second.tables["chunks"]["parts"].get(k) != third[k]]) == 1
    assert e.store.read("chunks", first).where("standard_id = 'IRC:5'").count() == 0 and e.corpus().where("standard_id = 'IRC:5'").count() == 1


def test_sources_and_sinks(spark, tmp_path):
    at = str(tmp_path)
    (tmp_path / "obs.csv").write_text('a,b\n"1,2",\n')
    assert readers.observations(spark, f"{at}/obs.csv").first() == ("1,2", None)
    assert readers.registry(spark, f"{at}/none.json").count() == 0
    (tmp_path / "reg.json").write_text(json.dumps({"standards": {"IRC:1": {"active_edition_year": 2000, "approved_sources": ["x.pdf"]}}}))
    assert readers.registry(spark, f"{at}/reg.json").first().standard_id == "IRC:1"
    (tmp_path / "gold.json").write_text("[]")
    with pytest.raises(ValueError):
        readers.gold(spark, f"{at}/gold.json")
    with pytest.raises(ValueError, match="schema"):
        sinks.save_manifest(spark.createDataFrame([("p", 2)], "source_path string, schema_version int"), f"{at}/m")
        readers.manifest(spark, f"{at}/m")
    docs = spark.createDataFrame([("a", "s", bytearray(b"x")), ("b", "t", bytearray(b"bad"))], "source_path string, document_sha256 string, content binary")

    def extractor(content):
        if content == b"bad":
            raise RuntimeError("broken")
        return [(1, "one", None), (2, "", "page 2: weak")]

    got = readers.extract_pages(docs, extractor).collect()
    assert sorted((r.source_path, r.page) for r in got if r.page) == [("a", 1), ("a", 2)] and [r.warning for r in got if r.page is None] == ["RuntimeError: broken"]
    rows = spark.createDataFrame([(17.0, 78.0, "SAFE", "</script>"), (None, None, "SAFE", "x")], "Latitude double, Longitude double, Overall_Severity string, note string")
    assert sinks.map_page(rows, f"{at}/map.html") == 1 and "<\\/script>" in (tmp_path / "map.html").read_text()
    made = []
    make = lambda: made.append(1) or spark.range(3).toDF("n")
    key = sinks.cache_key("x", settings.Settings().key())
    assert sinks.cached(spark, at, key, make).count() == 3 and sinks.cached(spark, at, key, make).count() == 3 and len(made) == 1
    assert sinks.cache_key("x", settings.Settings(final_k=3).key()) != key
    ups = readers.elevations(spark.createDataFrame([(1.0, 2.0)], "lat double, lon double"), lambda p: [a + b for a, b in p])
    assert ups.first().elevation == 3.0
    sinks.report_tables(rows, rows, rows, f"{at}/report", "csv")
    assert {p for p in os.listdir(f"{at}/report")} == {"audit_results", "standards", "run_metadata"}


def test_modes():
    s = settings.for_mode("audit")
    assert (s.dense_k, s.lexical_k, s.final_k, s.neighbour_window, s.exhaustive, s.rerank) == (80, 100, 12, 2, True, True)
    with pytest.raises(ValueError):
        settings.Settings(chunk_size=300)
    with pytest.raises(ValueError):
        settings.for_mode("other")


def test_streams_give_the_batch_result(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("r"), F.col("user_id") % 5).alias("route_id"), audit.severity((F.col("event_id") % 4).cast("int"), F.lit(0)).alias("severity"), (F.col("event_id") % 4).alias("failures"))
    e.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    for name, build in (("windows", incremental.severity_windows), ("sessions", incremental.route_sessions)):
        q = build(stream).writeStream.format("memory").queryName(name).outputMode("complete" if name == "windows" else "append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    batch = e.groupBy(F.window("ts", "5 minutes").alias("w"), "severity").count().select(F.col("w.start"), "severity", "count")
    assert sorted(map(tuple, spark.table("windows").collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)


def test_index_stream_skips_what_is_known(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one")
    seen = []

    def index(docs):
        rows = docs.select("source_path", "document_sha256", "chunking_version", "identity_version", F.lit(readers.INDEX_SCHEMA).alias("schema_version"))
        seen.append(rows.count())
        return rows

    def run():
        incremental.index_stream(spark, f"{tmp_path}/in", f"{tmp_path}/m", f"{tmp_path}/ck", index, "*.txt").awaitTermination(120)

    run()
    (tmp_path / "in" / "b.txt").write_text("two")
    (tmp_path / "in" / "c.txt").write_text("one")
    run()
    assert seen == [1, 1] and readers.manifest(spark, f"{tmp_path}/m").count() == 2


def test_model_client_retries_and_reports(spark):
    calls = pd.DataFrame({"request_id": ["a"], "metric_key": ["m"], "context_text": ["c"], "evidence": ["e"]})

    def client(*args):
        raise ConnectionError("down")

    got = readers.model_extractions(spark.createDataFrame(calls), client, attempts=2, backoff_s=0.01).first()
    assert got.status == "failed" and got.rationale == "down"


def test_settings_from_values():
    got = settings.Settings.from_values({"SPECAUDIT_DENSE_K": "40", "SPECAUDIT_RERANK": " Yes ", "SPECAUDIT_EXHAUSTIVE": "off", "SPECAUDIT_CORPUS_FOLDERS": "/a:/b:", "SPECAUDIT_MODEL": "m:8b", "OTHER": "1"})
    assert (got.dense_k, got.rerank, got.exhaustive, got.corpus_folders, got.model, got.lexical_k) == (40, True, False, ("/a", "/b"), "m:8b", 28)
    assert got.key() != settings.Settings().key()
    with pytest.raises(ValueError):
        settings.Settings.from_values({"SPECAUDIT_CHUNK_SIZE": "100"})


def test_health_tells_which_models_are_missing(spark, tmp_path):
    e = Engine(spark, f"{tmp_path}/c", settings.Settings(model="big", embedding_model="vectors:v2", reranker_model="none"))
    got = {r.check: (r.ok, r.detail) for r in e.health(lambda: ["big:latest", "vectors"]).collect()}
    assert got["model big"][0] and not got["model vectors:v2"][0] and not got["model none"][0] and not got["manifest"][0]

    def broken():
        raise ConnectionError("no answer")

    assert {r.detail for r in e.health(broken).collect() if r.check.startswith("model")} == {"ConnectionError: no answer"}
    assert {r.check for r in e.health().collect()} == {"manifest"}


def test_large_maps_go_to_several_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "PAGE_ROWS", 4)
    rows = spark.createDataFrame([(float(k), 78.0, "SAFE") for k in range(10)] + [(None, 1.0, "SAFE")], "Latitude double, Longitude double, Overall_Severity string")
    assert sinks.map_page(rows, f"{tmp_path}/map.html") == 10
    assert [(tmp_path / n).read_text().count('"Latitude"') for n in ("map.html", "map-2.html", "map-3.html")] == [4, 4, 2]
    assert sinks.map_page(rows.limit(0), f"{tmp_path}/none.html") == 0 and (tmp_path / "none.html").exists()


def test_features_of_a_service(spark):
    def fetch(south, west, north, east):
        if south > 50:
            raise ConnectionError("busy")
        return [{"way_id": 7, "tags": {"highway": "trunk", "lanes": 2}, "geometry": [(south, west), (north, east)]}, {"way_id": 8}]

    points = spark.createDataFrame([("a", 17.0, 78.0), ("a", 17.1, 78.2), ("b", 60.0, 1.0)], "route_id string, lat double, lon double")
    got = readers.features_near(points, fetch, backoff_s=0.0).collect()
    assert [(r.route_id, r.way_id, r.tags) for r in got] == [("a", "7", {"highway": "trunk", "lanes": "2"}), ("a", "8", {})]
    assert abs(got[0].geometry[0].lat - 16.998) < 1e-9 and abs(got[0].geometry[1].lon - 78.202) < 1e-9 and got[1].geometry == []


def test_a_service_is_asked_for_new_boxes_only(spark, tmp_path):
    log = tmp_path / "calls"
    log.write_text("")

    def fetch(south, west, north, east):
        with open(log, "a") as f:
            f.write(f"{south:.3f}\n")
        if south > 50:
            raise ConnectionError("busy")
        return [] if south > 30 else [{"way_id": 7, "tags": {"highway": "trunk"}, "geometry": [(south, west), (north, east)]}]

    calls = lambda: len(log.read_text().split())
    store = Store(spark, f"{tmp_path}/memo")
    points = spark.createDataFrame([("a", 17.0, 78.0), ("a", 17.1, 78.2), ("b", 60.0, 1.0), ("c", 40.0, 1.0), ("d", 17.00002, 78.00001), ("d", 17.09999, 78.2)], "route_id string, lat double, lon double")
    ask = lambda rows, **how: sorted((r.route_id, r.way_id) for r in readers.features_remembered(store, rows, fetch, attempts=2, backoff_s=0.0, **how).collect())
    assert ask(points) == [("a", "7"), ("d", "7")] and calls() == 4  # a and d share a box, b is tried twice
    assert ask(points) == [("a", "7"), ("d", "7")] and calls() == 6  # b alone, which failed; c is known to be empty
    more = points.where("route_id <> 'b'").unionByName(spark.createDataFrame([("x", 20.0, 78.0)], points.schema))
    assert ask(more) == [("a", "7"), ("d", "7"), ("x", "7")] and calls() == 7
    assert ask(more, days=0.0) == [("a", "7"), ("d", "7"), ("x", "7")] and calls() == 10  # all have expired


def test_workbooks_of_unlike_columns_keep_all(spark, tmp_path):
    for name, rows in (("b.xlsx", [{"ts": "1", "lanes": "2"}]), ("a.xlsx", [{"width": "3.5", "ts": "9"}, {"width": None, "ts": "8"}])):
        (tmp_path / name).write_text(json.dumps(rows))

    def read(body, nrows=None, dtype=None):
        return pd.DataFrame(json.loads(body.read())).head(nrows)

    got = readers._workbook(spark, str(tmp_path), read)
    assert got.columns == ["width", "ts", "lanes"]
    assert sorted(map(tuple, got.collect()), key=str) == [("3.5", "9", None), (None, "1", "2"), (None, "8", None)]


def test_route_contexts_of_a_stream_are_those_of_the_sheet(spark, tmp_path):
    from specaudit.operators import context

    rng = random.Random(3)
    pick = lambda *x: rng.choice([*x, None])
    rows = [(rng.choice("abcd"), pick("2", "4", "0", "x"), pick("0", "1", "3"), pick("2", "1 or 2"), pick("Chevron", "Mandatory Sign: speed limit 80", "speed limit 50", "nan", " ")) for _ in range(120)]
    schema = "route_id string, `Expected Total Lanes` string, `Centre Lanes Detected` string, `Shoulder Lanes Detected` string, `Traffic Sign Class` string"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = {}

        def keep(batch, _):
            for r in batch.collect():
                if r.route_id not in got or got[r.route_id].n_rows < r.n_rows:
                    got[r.route_id] = r

        def run():
            q = incremental.route_contexts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
            q.awaitTermination(240)
            assert q.exception() is None

        # two batches, then a restart with a third
        for first, last in ((0, 40), (40, 90)):
            spark.createDataFrame(rows[first:last], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run()
        spark.createDataFrame(rows[90:], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    expect = {r.route_id: r for r in context.from_sheet(spark.createDataFrame(rows, schema)).collect()}
    assert {k: tuple(r)[:-1] for k, r in got.items()} == {k: tuple(r) for k, r in expect.items()}
    assert sum(r.n_rows for r in got.values()) == 120
