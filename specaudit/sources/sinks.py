"""Writers: passage table, manifest, reports, caches."""

from __future__ import annotations

import html
import json
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specaudit.functions import text

#: Rows of a map page or a workbook sheet; more go to further pages and sheets.
PAGE_ROWS = 100_000


def _pages(df: DataFrame) -> Iterator[list]:
    """Rows in runs of ``PAGE_ROWS``, one partition at a time on the driver; an empty table is one empty run."""
    run: list = []
    some = False
    for row in df.toLocalIterator():
        run.append(row)
        if len(run) == PAGE_ROWS:
            yield run
            run, some = [], True
    if run or not some:
        yield run


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, body: str) -> None:
    """A small file, whole or not at all: written beside its place, which a rename then replaces in one step."""
    at, fs = _fs(spark, path)
    new, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(new, True)
    stream.write(bytearray(body.encode()))
    stream.close()
    kind = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    kinds = spark.sparkContext._gateway.new_array(kind, 1)
    kinds[0] = kind.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(new, at, kinds)


def save_manifest(manifest: DataFrame, path: str) -> None:
    """A new version beside the old one, then the pointer moves; readers see the one or the other."""
    spark, version = manifest.sparkSession, f"v-{uuid.uuid4().hex}"
    manifest.write.parquet(f"{path}/{version}")
    write_text(spark, f"{path}/CURRENT", version)


def report_tables(audited: DataFrame, standards: DataFrame, run: DataFrame, folder: str, form: str = "parquet") -> None:
    """The three tables of an audit report; as a workbook too where pandas can write one (``form='xlsx'``)."""
    tables = {"audit_results": audited, "standards": standards, "run_metadata": run}
    if form != "xlsx":
        for name, df in tables.items():
            df.write.mode("overwrite").option("header", "true").format(form).save(f"{folder}/{name}")
        return
    import pandas as pd

    with pd.ExcelWriter(f"{folder}/report.xlsx") as book:
        for name, df in tables.items():
            for k, rows in enumerate(_pages(df), 1):
                pd.DataFrame(rows, columns=df.columns).to_excel(book, sheet_name=name if k == 1 else f"{name}-{k}", index=False, freeze_panes=(1, 0))


def standards_sheet(rules: DataFrame) -> DataFrame:
    """Rules as they are reported; citation fields are flat."""
    cite = [F.col(f"citation.{c}").alias(f"citation_{c}") for c in ("evidence_id", "standard_id", "edition_year", "source", "page", "section", "quote", "retrieval_score", "content_hash") if "citation" in rules.columns]
    plain = [c for c in ("route_id", "metric_key", "metric_name", "status", "value_m", "second_value_m", "comparator", "quality", "provisional", "basis", "reason") if c in rules.columns]
    lists = [F.array_join(c, "; ").alias(c) for c in ("conditions", "missing_context") if c in rules.columns]
    return rules.select(*plain, *lists, *cite)


def map_page(audited: DataFrame, path: str, title: str = "Audit map") -> int:
    """Self-contained pages of the geotagged rows, ``PAGE_ROWS`` each (``map.html``, ``map-2.html``, ..); returns how many rows they show."""
    shown = 0
    stem, dot, ending = path.rpartition(".")
    for k, rows in enumerate(_pages(audited.dropna(subset=["Latitude", "Longitude"]).select(F.to_json(F.struct("*")))), 1):
        at = path if k == 1 else f"{stem}-{k}.{ending}" if dot else f"{path}-{k}"
        write_text(audited.sparkSession, at, _map([r[0] for r in rows], title if k == 1 else f"{title}, page {k}"))
        shown += len(rows)
    return shown


def _map(rows: list[str], title: str) -> str:
    counts: dict[str, int] = {}
    for r in rows:
        s = json.loads(r)["Overall_Severity"]
        counts[s] = counts.get(s, 0) + 1
    data = "[" + ",".join(rows) + "]"
    data = data.replace("</", "<\\/")
    legend = "".join(f"<li>{html.escape(k)}: {n}</li>" for k, n in sorted(counts.items()))
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><ul>{legend}</ul><svg id=m width=900 height=600></svg><pre id=d></pre><script>const rows={data};const xs=rows.map(r=>r.Longitude),ys=rows.map(r=>r.Latitude),x0=Math.min(...xs),x1=Math.max(...xs),y0=Math.min(...ys),y1=Math.max(...ys);for(const r of rows){{const c=document.createElementNS('http://www.w3.org/2000/svg','circle');c.setAttribute('cx',20+860*(r.Longitude-x0)/((x1-x0)||1));c.setAttribute('cy',580-560*(r.Latitude-y0)/((y1-y0)||1));c.setAttribute('r',4);c.onclick=()=>document.getElementById('d').textContent=JSON.stringify(r,null,1);document.getElementById('m').append(c)}}</script>"


def evaluation_json(summary: DataFrame, path: str) -> None:
    write_text(summary.sparkSession, path, json.dumps(summary.first().asDict(recursive=True), sort_keys=True, indent=1, default=str))


def cache_key(*parts: str) -> str:
    """Key of a cached result: inputs and all settings (see ``Settings.key``)."""
    import hashlib

    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()


def cached(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A result stored under its key, made once."""
    path = f"{folder}/{key}"
    done, fs = _fs(spark, f"{path}/_SUCCESS")
    if not fs.exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def safe_html(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(text.escape_html(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns))
