"""Readers: documents, pages, observations, configuration, index tables, map features, model services."""

from __future__ import annotations

import importlib
import io
import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from specaudit.sources.versions import Store, cut

PAGES = "source_path string, document_sha256 string, page int, text string, parser string, warning string"
POLICY = "standard_id string, active_edition_year int, approved_sources array<string>, source_aliases array<string>, approved_sha256 array<string>, official_source_url string, licence_basis string, amendments array<string>, supersedes array<string>, reviewed_by string, reviewed_on string, notes string"
RECORD = "evidence_id string, metric_key string, standard_id string, edition_year int, source string, source_sha256 string, page int, section string, text string, verification string"
OVERRIDE = "id string, highway_ref string, min_lat double, max_lat double, min_lon double, max_lon double, carriageway string, lanes_per_carriageway int, carriageway_count int, total_road_lanes int, barrier_type string, review_status string"
GOLD = "case_id string, metric_key string, road_context map<string,string>, expected_standard_id string, expected_edition_year int, expected_page int, expected_evidence_id string, expected_content_hash string, expected_quote string, expected_value_m double, expected_second_value_m double, expected_comparator string, expected_status string, expected_applicable boolean, observed_values_m array<double>, expected_audit_decision string, reviewer_id string, reviewed_on string, notes string"
INDEX_SCHEMA = 3


def documents(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """Files under a folder with their digest: ``source_path, source, document_sha256, content``; paths that differ by case count once."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    own = raw.select(F.col("path").alias("source_path"), F.element_at(F.split("path", "/"), -1).alias("source"), F.sha2("content", 256).alias("document_sha256"), "content")
    first = own.groupBy(F.lower("source_path").alias("k")).agg(F.min("source_path").alias("source_path")).drop("k")
    return own.join(first, "source_path", "left_semi")


def pypdf_pages(content: bytes) -> list[tuple[int, str, str | None]]:
    """Pages by the optional pypdf library; an unreadable page gives an empty text and a warning."""
    pypdf = importlib.import_module("pypdf")
    reader = pypdf.PdfReader(io.BytesIO(content))
    if reader.is_encrypted:
        reader.decrypt("")
    out = []
    for n, page in enumerate(reader.pages, 1):
        try:
            out.append((n, page.extract_text() or "", None))
        except Exception as failure:  # one bad page does not cost the document
            out.append((n, "", f"page {n}: {failure}"))
    return out


def converted_pages(content: bytes) -> list[tuple[int, str, str | None]]:
    """Pages as Markdown by the optional docling library, which reads scans by OCR and keeps tables; text of a page comes in reading order."""
    converter = importlib.import_module("docling.document_converter").DocumentConverter()
    stream = importlib.import_module("docling.datamodel.base_models").DocumentStream(name="document.pdf", stream=io.BytesIO(content))
    found = converter.convert(stream).document
    return [(n, found.export_to_markdown(page_no=n) or "", None) for n in sorted(found.pages)]


def extract_pages(docs: DataFrame, extractor: Callable[[bytes], list[tuple[int, str, str | None]]] = pypdf_pages, parser: str = "pypdf") -> DataFrame:
    """One row a page.  A document that fails gives one row without a page and with the warning, and the others go on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, sha, content in pdf.itertuples(index=False):
                try:
                    rows += [(path, sha, n, text, parser, w) for n, text, w in extractor(bytes(content))]
                except Exception as failure:
                    rows.append((path, sha, None, None, parser, f"{type(failure).__name__}: {failure}"))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PAGES.split(", ")]).astype({"page": "Int32"})

    return docs.select("source_path", "document_sha256", "content").mapInPandas(run, PAGES)


def text_pages(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """Plain-text documents, pages parted by form feeds."""
    own = documents(spark, folder, glob).select("source_path", "document_sha256", F.posexplode(F.split(F.decode("content", "UTF-8"), "\f")).alias("n", "text"))
    return own.select("source_path", "document_sha256", (F.col("n") + 1).alias("page"), "text", F.lit("text").alias("parser"), F.lit(None).cast("string").alias("warning"))


def observations(spark: SparkSession, path: str) -> DataFrame:
    """Observation sheet, every cell as text: CSV natively, workbooks by pandas where it has an engine for them."""
    if path.lower().endswith((".xlsx", ".xls")):
        return _workbook(spark, path)
    return spark.read.option("header", "true").option("inferSchema", "false").option("multiLine", "true").option("escape", '"').csv(path)


def _workbook(spark: SparkSession, path: str, read: Callable[..., pd.DataFrame] | None = None) -> DataFrame:
    """First sheet of each workbook under ``path``, read by tasks.  The columns are those of all workbooks, in the order in which the files, by name, bring them; a workbook without one has nulls there.

    ``read`` stands for ``pandas.read_excel`` and its engines.
    """
    books = spark.read.format("binaryFile").load(path).select("path", "content")
    read = read or pd.read_excel

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, content in zip(pdf["path"], pdf["content"], strict=True):
                own = [str(c) for c in read(io.BytesIO(content), nrows=0).columns]
                yield pd.DataFrame({"path": at, "place": range(len(own)), "name": own})

    # one row a distinct column reaches the driver
    found = books.mapInPandas(names, "path string, place int, name string").groupBy("name").agg(F.min(F.struct("path", "place")).alias("first"))
    columns = [r["name"] for r in found.orderBy("first").collect()]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                sheet = read(io.BytesIO(content), dtype=str)
                sheet.columns = [str(c) for c in sheet.columns]
                yield sheet.reindex(columns=columns).astype(object).where(lambda d: d.notna(), None)

    return books.mapInPandas(rows, StructType([StructField(c, StringType()) for c in columns]))


def _json(spark: SparkSession, path: str, missing_ok: bool = True) -> list[dict]:
    """Small configuration file (a list or a map of objects); read by Spark, so any store will do."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        if missing_ok:
            return []
        raise FileNotFoundError(path)
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def _frame(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    kinds = StructType.fromDDL(schema)
    return spark.createDataFrame([tuple(r.get(n) for n in kinds.names) for r in rows], kinds)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Standards registry: policies by id; a missing file is an empty registry."""
    data = _json(spark, path)
    data = data.get("standards", data) if isinstance(data, dict) else data
    rows = [v | {"standard_id": k} for k, v in data.items()] if isinstance(data, dict) else data
    return _frame(spark, rows, POLICY)


def structured_evidence(spark: SparkSession, path: str) -> DataFrame:
    data = _json(spark, path)
    return _frame(spark, data.get("records", []) if isinstance(data, dict) else data, RECORD)


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """Reviewed route overrides with their list position."""
    data = _json(spark, path)
    rows = data.get("overrides", []) if isinstance(data, dict) else data
    return _frame(spark, [r | r.get("bounds", {}) | {"position": k} for k, r in enumerate(rows)], "position int, " + OVERRIDE)


def gold(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases; an empty or other file is an error."""
    rows = _json(spark, path, missing_ok=False)
    if not isinstance(rows, list) or not rows:
        raise ValueError("gold cases must be a non-empty list")
    return _frame(spark, rows, GOLD)


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """Current manifest by its pointer; None before the first run.  Mixed schema versions are refused."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    pointer = jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT")
    if not pointer.getFileSystem(conf).exists(pointer):
        return None
    return checked_manifest(spark.read.parquet(f"{path}/{spark.read.text(f'{path}/CURRENT').first()[0]}"))


def checked_manifest(table: DataFrame) -> DataFrame:
    """A manifest whose rows all have the schema version that this engine writes."""
    found = [r[0] for r in table.select("schema_version").distinct().limit(5).collect()]
    if any(v != INDEX_SCHEMA for v in found):
        raise ValueError(f"index has schema {found}, this engine writes {INDEX_SCHEMA}: rebuild it")
    return table


def map_features(spark: SparkSession, path: str) -> DataFrame:
    """Offline map features as JSON lines: ``way_id, tags, geometry``."""
    return spark.read.schema("way_id string, tags map<string,string>, geometry array<struct<lat:double,lon:double>>").json(path)


def _fetched(boxes: DataFrame, key: str, fetch: Callable[[float, float, float, float], list[dict]], attempts: int, backoff_s: float) -> DataFrame:
    """Features of boxes ``key, south, west, north, east``; a row without ``way_id`` closes each box and says whether the service ``failed``."""

    def ask(*box: float) -> list[dict] | None:
        for n in range(attempts):
            try:
                return fetch(*box)
            except ConnectionError:
                time.sleep(backoff_s * 2**n if n + 1 < attempts else 0)
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for r in pdf.itertuples(index=False):
                got = ask(*(float(x) for x in r[1:]))
                for f in got or []:
                    rows.append((r[0], str(f["way_id"]), {str(k): str(v) for k, v in (f.get("tags") or {}).items()}, [{"lat": float(a), "lon": float(b)} for a, b in f.get("geometry") or []], False))
                rows.append((r[0], None, None, None, got is None))
            yield pd.DataFrame(rows, columns=[key, "way_id", "tags", "geometry", "failed"])

    kind = dict(boxes.dtypes)[key]
    return boxes.select(key, "south", "west", "north", "east").mapInPandas(run, f"{key} {kind}, way_id string, tags map<string,string>, geometry array<struct<lat:double,lon:double>>, failed boolean")


def _boxes(routes: DataFrame, margin_deg: float) -> DataFrame:
    low, high = (lambda c: F.min(c) - margin_deg), (lambda c: F.max(c) + margin_deg)
    return routes.groupBy("route_id").agg(low("lat").alias("south"), low("lon").alias("west"), high("lat").alias("north"), high("lon").alias("east"))


def features_near(routes: DataFrame, fetch: Callable[[float, float, float, float], list[dict]], margin_deg: float = 0.002, attempts: int = 3, backoff_s: float = 0.5) -> DataFrame:
    """``route_id, way_id, tags, geometry`` of the features in each route's box, by an injected service call.

    routes: ``route_id, lat, lon`` (points).  ``fetch`` gets south, west, north, east and gives objects with ``way_id, tags, geometry``
    (pairs of latitude and longitude).  Transient failures (``ConnectionError``) are tried again, then the route has no features.
    """
    return _fetched(_boxes(routes, margin_deg), "route_id", fetch, attempts, backoff_s).where("way_id is not null").drop("failed")


#: Degrees to which a box is widened before it is asked for, so that routes close to each other share an answer.
MEMO_STEP = 0.001


def features_remembered(store: Store, routes: DataFrame, fetch: Callable[[float, float, float, float], list[dict]], days: float = 30.0, margin_deg: float = 0.002, attempts: int = 3, backoff_s: float = 0.5) -> DataFrame:
    """As :func:`features_near`, but a box that the service answered within ``days`` is not asked for again.

    Answers stand in a table ``fetched`` of the store by the box's rounded corners, and boxes without one are all that the service is asked for; a box
    whose call failed is not remembered.  The answers become one version; another writer's in between is a :class:`~specaudit.sources.versions.Conflict`.
    """
    down, up = (lambda c: F.floor(F.round(F.col(c) / MEMO_STEP, 6)).cast("long")), (lambda c: F.ceil(F.round(F.col(c) / MEMO_STEP, 6)).cast("long"))
    corners = _boxes(routes, margin_deg).select("route_id", down("south").alias("s"), down("west").alias("w"), up("north").alias("n"), up("east").alias("e"))
    boxes = cut(corners.withColumn("box", F.concat_ws(",", "s", "w", "n", "e")))
    change = store.begin()
    old = store.read("fetched", change.base)
    asked = boxes.dropDuplicates(["box"]).select("box", *((F.col(c) * MEMO_STEP).alias(name) for c, name in (("s", "south"), ("w", "west"), ("n", "north"), ("e", "east"))))
    fresh = F.col("fetched_at") >= F.current_timestamp() - F.make_dt_interval(secs=F.lit(float(days) * 86_400))
    if old is not None:
        asked = asked.join(old.where(fresh & F.col("way_id").isNull()).select("box").distinct(), "box", "left_anti")
    asked = cut(asked)
    if asked.limit(1).count():
        got = _fetched(asked, "box", fetch, attempts, backoff_s).where(~F.col("failed")).drop("failed")
        change.append("fetched", got.withColumn("fetched_at", F.current_timestamp()).withColumn("born", F.lit(change.number)), "box")
        at = change.commit()
    else:
        at = change.base
    known = store.read("fetched", at)
    # of a box that was asked for again the last answer holds
    last = known.where("way_id is null").groupBy("box").agg(F.max("born").alias("born"))
    rows = known.where("way_id is not null").join(last, ["box", "born"]).drop("born", "fetched_at", "bucket")
    return boxes.select("route_id", "box").join(rows, "box").select("route_id", "way_id", "tags", "geometry")


def model_ready(name: str, available: list[str]) -> bool:
    """Whether a service lists a model under its name, or under its name with some tag behind a colon."""
    return any(name == x or name == x.split(":")[0] for x in available)


def public_tags(tags: Column) -> Column:
    """Tags without those of the engine's own."""
    return F.map_filter(tags, lambda k, v: ~k.startswith("_"))


def elevations(points: DataFrame, lookup: Callable[[list[tuple[float, float]]], list[float]]) -> DataFrame:
    """Adds ``elevation`` by a pluggable lookup, a batch at a time; a lookup of another length is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = lookup(list(zip(pdf["lat"], pdf["lon"], strict=True)))
            if len(got) != len(pdf):
                raise ValueError("elevation lookup returned another number of values")
            yield pdf.assign(elevation=[float(x) for x in got])

    return points.mapInPandas(run, StructType([*points.schema.fields, StructField("elevation", DoubleType())]))


EXTRACTION = "status string, evidence_id string, quote string, raw_value double, second_raw_value double, raw_unit string, comparator string, applies_to string, conditions array<string>, rationale string"


def model_extractions(requests: DataFrame, client: Callable[[str, str, str], dict], attempts: int = 3, backoff_s: float = 0.5) -> DataFrame:
    """Extractions proposed by an injected model client for ``request_id, metric_key, context_text, evidence``.

    Transient failures (``ConnectionError``) are tried again; others give ``status = failed`` with the message, so one request never stops the rest.
    """
    names = [x.strip().split()[0] for x in EXTRACTION.split(",") if " " in x.strip()]

    def ask(*args: str) -> dict:
        for n in range(attempts):
            try:
                return client(*args)
            except ConnectionError as failure:
                if n + 1 == attempts:
                    return {"status": "failed", "rationale": str(failure)}
                time.sleep(backoff_s * 2**n)
            except Exception as failure:
                return {"status": "failed", "rationale": str(failure)}
        return {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [ask(*row) for row in pdf[["metric_key", "context_text", "evidence"]].itertuples(index=False)]
            yield pd.concat([pdf[["request_id", "metric_key"]].reset_index(drop=True), pd.DataFrame([[g.get(n) for n in names] for g in got], columns=names)], axis=1)

    return requests.select("request_id", "metric_key", "context_text", "evidence").mapInPandas(run, f"request_id string, metric_key string, {EXTRACTION}")


def embeddings(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], text_col: str = "text", batch: int = 96) -> DataFrame:
    """Adds ``embedding`` by an injected model, ``batch`` texts a call."""

    @F.pandas_udf("array<float>")
    def vector(texts: pd.Series) -> pd.Series:
        out: list[list[float]] = []
        own = texts.fillna("").tolist()
        for k in range(0, len(own), batch):
            out += embed(own[k : k + batch])
        return pd.Series(out)

    return rows.withColumn("embedding", vector(F.col(text_col)))
