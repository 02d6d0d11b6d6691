"""Boilerplate lines by site-relative frequency.

A line's frequency on a host is the number of the host's pages that contain it, over the
number of the host's pages.  Lines above the ratio are dropped from all pages of that host, however few pages it
has, if they stand on ``least`` pages at least: a line of one page, or of a page and its copy, is no boilerplate.

Lines are compared without blanks at their ends; empty lines are never dropped.

Counting sends 16 bytes a distinct line of a page, summed on each task first.  A page of a
host holds at most 1/ratio of the mean page's lines in boilerplate, so a host's list of
boilerplate hashes is at most 1/ratio times as long as its mean page; it is joined to pages on the
host, one row a host, which AQE splits where a host is hot (and Spark broadcasts when its files are small), and
a task makes it a set once for all pages of the host that follow each other.

Defined cases: a null text counts as empty (and the cleaned text is then empty); null hosts are one
host; a repeated row is a page of its own; an empty table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specaudit.llm.common import materialize, small_batches

RATIO = 0.05
LEAST_PAGES = 3


def host_of(url: Column) -> Column:
    """Host of a URL, lower-cased, without user and port."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _key(host: Column) -> Column:
    return F.coalesce(F.concat(F.lit("h"), host.cast("string")), F.lit("-"))


def boilerplate(df: DataFrame, host_col: str, text_col: str, ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """``host, lines``: 16-byte hashes of each host's boilerplate lines."""
    pages = df.select(_key(df[host_col]).alias("host"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    own = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    lines = pages.select("host", F.explode(own).alias("line")).select("host", F.unhex(F.substring(F.sha2("line", 256), 1, 32)).alias("line"))
    seen = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return seen.join(totals, "host").where(F.col("n") > F.lit(ratio) * F.col("pages")).groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(df: DataFrame, host_col: str = "source", text_col: str = "text", *, ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """``df`` with boilerplate lines gone from its text, and ``n_lines`` and ``n_dropped`` in front (as ``__n_lines``, ``__n_dropped``)."""
    small_batches(df.sparkSession)
    drops = materialize(boilerplate(df, host_col, text_col, ratio, least), "line-dedup-lines")
    # the input's columns travel by number, so none of their names can clash
    rows = df.select(_key(df[host_col]).alias("host"), *(df[c].alias(f"c{k}") for k, c in enumerate(df.columns)))
    joined = rows.join(drops, "host", "left").select("host", "lines", *rows.columns[1:])
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 2 + columns.index(text_col)
        host, gone = None, None
        for batch in batches:
            n_lines, n_dropped, texts = [], [], []
            for key, text, own in zip(batch.column(0).to_pylist(), batch.column(at).to_pylist(), batch.column(1), strict=True):
                if key != host:
                    host, gone = key, set(own.as_py()) if own.is_valid else None
                lines = (text or "").split("\n")
                n_lines.append(len(lines))
                stay = lines if gone is None else [x for x in lines if not (y := x.strip(" ")) or hashlib.sha256(y.encode()).digest()[:16] not in gone]
                n_dropped.append(len(lines) - len(stay))
                texts.append("\n".join(stay))
            out = batch.columns[2:]
            out[at - 2] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), *out], names=["__n_lines", "__n_dropped", *columns])

    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return joined.mapInArrow(run, f"__n_lines long, __n_dropped long, {kinds}")
