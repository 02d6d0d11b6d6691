"""Streams that keep the batch operators' semantics.

Extensions: the batch engine does not need them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from specaudit.operators import audit, context, corpus
from specaudit.sources import readers, sinks


def index_stream(spark: SparkSession, folder: str, manifest_path: str, checkpoint: str, index: Callable[[DataFrame], DataFrame], glob: str = "*.pdf") -> StreamingQuery:
    """Index what is new in a folder, then stop.

    ``index`` takes documents to index, writes their passages and gives their manifest rows; a batch that is run
    again after a failure skips what its first run recorded.
    """
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    docs = source.select(F.col("path").alias("source_path"), F.element_at(F.split("path", "/"), -1).alias("source"), F.sha2("content", 256).alias("document_sha256"), "content")

    def batch(found: DataFrame, _: int) -> None:
        from specaudit.operators.chunking import VERSION

        found = found.withColumn("chunking_version", F.lit(VERSION)).withColumn("identity_version", F.lit(corpus.IDENTITY_VERSION))
        before = readers.manifest(spark, manifest_path)
        fresh = found if before is None else corpus.to_index(found, before)
        rows = index(fresh)
        if before is not None:
            rows = before.join(rows.select("source_path"), "source_path", "left_anti").unionByName(rows)
        sinks.save_manifest(rows, manifest_path)

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audit_stream(observations: DataFrame, rules: DataFrame, context: DataFrame) -> DataFrame:
    """Continuous audit: a stateless join of each batch with the static rules and contexts."""
    return audit.audit_rows(observations, rules, context)


def severity_windows(audited: DataFrame, time: str = "ts", width: str = "5 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Severity counts in event-time windows; rows later than ``late`` are left out of closed windows."""
    own = F.window(F.col(time), width, slide) if slide else F.window(F.col(time), width)
    return audited.withWatermark(time, late).groupBy(own.alias("w"), "severity").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "severity", "n")


def route_sessions(audited: DataFrame, time: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Failures of each route's driving sessions."""
    return audited.withWatermark(time, late).groupBy(F.session_window(F.col(time), gap).alias("w"), "route_id").agg(F.count(F.lit(1)).alias("n"), F.sum("failures").alias("failures")).select("route_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "failures")


#: What is counted of a route's rows, and what a batch says of each route that it touches.
COUNTED = ("lanes", "centre", "shoulder", "speed", "sign")
SUMMED = "route_id string, lanes double, centre double, shoulder double, speed double, signs array<string>, n_rows long"


class SheetState(StatefulProcessor):
    """A route's facts as counts of their distinct values: order of arrival does not matter, and a long drive costs no more than its different values.

    A route that is silent for ``expire_ms`` is forgotten by a timer, each of its rows putting the timer off.
    """

    def __init__(self, expire_ms: int | None = None):
        self.expire_ms = expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "fact string, value string", "n long")
        self.rows = handle.getValueState("rows", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[tuple[str, str], int] = {}
        n = 0
        for pdf in rows:
            n += len(pdf)
            for fact in COUNTED:
                for value, count in pdf[fact].dropna().value_counts().items():
                    at = (fact, str(value) if fact == "sign" else repr(float(value)))
                    new[at] = new.get(at, 0) + int(count)
        for at, count in new.items():
            known = self.counts.getValue(at)[0] if self.counts.containsKey(at) else 0
            self.counts.updateValue(at, (known + count,))
        n += self.rows.get()[0] if self.rows.exists() else 0
        self.rows.update((n,))
        if self.expire_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.expire_ms)
        yield self._summed(key[0], n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.counts.clear()
        self.rows.clear()
        return iter([])

    def _summed(self, route: str, n: int) -> pd.DataFrame:
        values: dict[str, list] = {fact: [] for fact in COUNTED}
        for (fact, value), (count,) in self.counts.iterator():
            values[fact].append((value if fact == "sign" else float(value), count))

        def upper_median(pairs: list) -> float | None:
            place = sum(c for _, c in pairs) // 2
            for value, count in sorted(pairs):
                if place < count:
                    return value
                place -= count
            return None

        medians = {fact: [upper_median(values[fact])] for fact in COUNTED[:-1]}
        return pd.DataFrame({"route_id": [route], **medians, "signs": [sorted(v for v, _ in values["sign"])], "n_rows": [n]})[["route_id", "lanes", "centre", "shoulder", "speed", "signs", "n_rows"]]

    def close(self) -> None:
        pass


def route_contexts(observations: DataFrame, expire_ms: int | None = None) -> DataFrame:
    """The sheet context of each route as far as it has been seen, a row for each route that a batch touches, with ``n_rows`` (the largest is the latest).

    After all rows it is :func:`specaudit.operators.context.from_sheet` of them, in whatever order and batches they came.  Needs the RocksDB state store.
    """
    facts = context.sheet_facts(observations).withColumn("route_id", F.col("route_id").cast("string"))
    summed = facts.groupBy("route_id").transformWithStateInPandas(SheetState(expire_ms), outputStructType=SUMMED, outputMode="Update", timeMode="None" if expire_ms is None else "ProcessingTime")
    return context.summed_sheet(summed, "n_rows")
