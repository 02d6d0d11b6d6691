"""A stored inverted index: BM25 without reading the corpus.

Tables of a :class:`~specaudit.sources.versions.Store`, next to the passages they index: ``postings`` (by bucket of the token: a row
for a token and a range of passages, with the passages' counts and lengths, the largest count, the least length and the sum of counts), ``removed``
(how many postings of a token are gone, and their counts' sum) and ``tombstones`` (passages gone, and the version that took them).  The number of passages and
of their tokens are numbers of the version.  A change adds the postings of new passages and what is gone; nothing old is read again
until :func:`compact`.

A search reads the buckets of its tokens.  Bounds come first: the largest count with the least length can't be exceeded in a range
whatever the statistics are now, so a range whose bounds add up to less than a score that ``k`` passages have is never opened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specaudit.functions import text
from specaudit.operators import retrieval
from specaudit.operators.retrieval import B, K1
from specaudit.sources.versions import WRITERS, Change, Snapshot, Store, bucket_of

#: Ranges of passages at first; about so many passages share a range after :func:`compact`.
RANGES, RANGE_SIZE = 64, 1024
#: Passages whose tokens are counted together.
PASSAGES = 1024
#: Ranges of a query that are opened for a first score to beat.
FIRST = 4
#: Writes that a bucket may have before :func:`compact` is due.
MOST_WRITES = 8


def _counts(passages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``corpus_idx, dl, token, tf``, counted within each passage (a row): nothing is shuffled."""
    own = passages.select(F.col(id_col).cast("long").alias("corpus_idx"), text.tokens(F.coalesce(text_col, F.lit(""))).alias("ts"))
    return own.mapInArrow(_counted, "corpus_idx long, dl int, token string, tf int")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # some passages at a time, so that lists of one batch never become one huge array
        for k in range(0, batch.num_rows, PASSAGES):
            ids, ts = batch.column("corpus_idx").slice(k, PASSAGES), batch.column("ts").slice(k, PASSAGES)
            words, dl = ts.flatten().dictionary_encode(), ts.value_lengths().to_numpy(zero_copy_only=False)
            if len(words):
                n = len(words.dictionary)
                pairs, tf = np.unique(np.repeat(np.arange(len(ids)), dl) * n + words.indices.to_numpy(), return_counts=True)
                row = pairs // n
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(dl[row], pa.int32()), words.dictionary.take(pa.array(pairs % n)).cast(pa.string()), pa.array(tf, pa.int32())], names=["corpus_idx", "dl", "token", "tf"])


def _range(ranges: int) -> Column:
    return F.pmod(F.xxhash64("corpus_idx"), F.lit(ranges)).cast("int")


def _blocks(counts: DataFrame, ranges: int, born: Column, buckets: int) -> DataFrame:
    """Rows of ``postings`` where they are written: single postings are shuffled once, to the writers of their bucket."""
    rows = counts.withColumn("range", _range(ranges)).withColumn("bucket", bucket_of(F.col("token"), buckets)).withColumn("writer", F.pmod(F.xxhash64("token", "range"), F.lit(WRITERS)))
    # sorted by one number, so that Spark's radix sort does it; where two tokens share it, a list is in more than one row, which a search adds up
    own = rows.select("bucket", "writer", "token", "range", "corpus_idx", "tf", "dl", born.cast("long").alias("born")).repartition("bucket", "writer").drop("writer").withColumn("key", F.xxhash64("token", "range"))
    return own.sortWithinPartitions("key").drop("key").mapInArrow(_packed, "bucket int, token string, range int, docs array<struct<corpus_idx: bigint, tf: int, dl: int, born: bigint>>, max_tf int, min_dl int, total long, n int")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each token and range of postings that come together; a list may come in several batches."""
    held: list[pa.RecordBatch] = []

    def closed() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        col = {c: t.column(c).combine_chunks() for c in t.column_names}
        starts = np.concatenate(([0], _steps(col["token"], col["range"])))
        tf, dl = col["tf"].to_numpy(), col["dl"].to_numpy()
        docs = pa.ListArray.from_arrays(pa.array(np.append(starts, len(t)), pa.int32()), pa.StructArray.from_arrays([col[c] for c in ("corpus_idx", "tf", "dl", "born")], ["corpus_idx", "tf", "dl", "born"]))
        first = {c: col[c].take(pa.array(starts)) for c in ("bucket", "token", "range")}
        numbers = {"max_tf": np.maximum.reduceat(tf, starts), "min_dl": np.minimum.reduceat(dl, starts), "total": np.add.reduceat(tf.astype(np.int64), starts), "n": np.diff(np.append(starts, len(t))).astype(np.int32)}
        return pa.RecordBatch.from_pydict({**first, "docs": docs, **{k: pa.array(v) for k, v in numbers.items()}})

    for batch in batches:
        if not batch.num_rows:
            continue
        key = lambda b, k: (b.column("token")[k], b.column("range")[k])
        if held and key(held[-1], held[-1].num_rows - 1) != key(batch, 0):
            yield closed()
            held = []
        steps = _steps(batch.column("token"), batch.column("range"))
        if len(steps):
            held.append(batch.slice(0, steps[-1]))
            yield closed()
            held = []
        held.append(batch.slice(steps[-1] if len(steps) else 0))
    if held:
        yield closed()


def _steps(*keys: pa.Array) -> np.ndarray:
    """Rows whose key isn't that of the row before."""
    new = [pc.not_equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False) for k in keys]
    return np.flatnonzero(np.logical_or.reduce(new)) + 1


def update(change: Change, added: DataFrame | None, gone: DataFrame | None = None, id_col: str = "corpus_idx", text_col: str = "text") -> None:
    """Index ``added`` passages and forget ``gone`` ones within a change; a passage in both is replaced."""
    numbers, buckets = change.numbers, change.buckets("postings")
    ranges = numbers.setdefault("ranges", RANGES)

    def count(rows: DataFrame, written: DataFrame, sign: int) -> None:
        # a passage's length is the sum of its counts, so no text is cut into tokens again
        numbers["passages"] = numbers.get("passages", 0) + sign * rows.count()
        numbers["tokens"] = numbers.get("tokens", 0) + sign * written.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]

    if gone is not None:
        change.append("tombstones", gone.select(F.col(id_col).cast("long").alias("corpus_idx"), F.lit(change.number).cast("long").alias("died")), "corpus_idx")
        count(gone, change.append("removed", _counts(gone, id_col, text_col).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("total")), "token", buckets), -1)
    if added is not None:
        count(added, change.append("postings", _blocks(_counts(added, id_col, text_col), ranges, F.lit(change.number), buckets), None, buckets, placed=True), 1)


def due(at: Snapshot) -> bool:
    return any(len(w) > MOST_WRITES for w in at.tables.get("postings", {}).get("parts", {}).values())


def without_gone(store: Store, at: Snapshot, rows: DataFrame) -> DataFrame:
    """Rows (``corpus_idx, born, ..``) without those whose passage went in a later version."""
    tombstones = store.read("tombstones", at)
    if tombstones is None:
        return rows
    last = tombstones.groupBy(F.col("corpus_idx").alias("__gone")).agg(F.max("died").alias("__died"))
    return rows.join(last, (F.col("corpus_idx") == F.col("__gone")) & (F.col("born") < F.col("__died")), "left_anti")


def _live(store: Store, at: Snapshot, postings: DataFrame) -> DataFrame:
    """Single postings of rows with ``docs``."""
    return without_gone(store, at, postings.withColumn("d", F.explode("docs")).drop("docs").select("*", "d.*").drop("d"))


def compact(store: Store) -> Snapshot:
    """All postings written anew in ranges that fit the corpus, without what is gone; its own version."""
    change = store.begin()
    at = change.base
    ranges = max(RANGES, 1 << max(0, at.numbers["passages"] // RANGE_SIZE).bit_length())
    rows = _live(store, at, store.read("postings", at).select("token", "docs"))
    buckets = change.buckets("postings")
    change.replace("postings", _blocks(rows, ranges, F.col("born"), buckets), None, None, buckets, placed=True)
    change.numbers["ranges"] = ranges
    if "vectors" in at.tables:
        # what is gone must not come back when its tombstone goes
        vectors = without_gone(store, at, store.read("vectors", at))
        change.replace("vectors", vectors, None)
    change.drop("tombstones")
    change.drop("removed")
    return change.commit()


def _impact(tf: Column, dl: Column, avgdl: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


class Search:
    """A batch of queries against one version: ``bounds``, ``opened`` and ``top`` are DataFrames."""

    def __init__(self, store: Store, queries: DataFrame, k: int, at: Snapshot | None = None):
        self.store, self.k, self.at = store, k, at or store.snapshot()
        self.keys = ["request_id", "query_idx"]
        self.n, self.avgdl = self.at.numbers.get("passages", 0), max(1.0, self.at.numbers.get("tokens", 0) / max(1, self.at.numbers.get("passages", 0)))
        asked = retrieval.query_tokens(queries)
        self.few = retrieval._small(asked, retrieval.BROADCAST_TOKENS)
        buckets = self.at.tables["postings"]["buckets"]
        self.buckets = None
        if self.few:
            self.buckets = sorted(r[0] for r in asked.select(bucket_of(F.col("token"), buckets)).distinct().collect())
        self._asked = asked
        self.postings = store.read("postings", self.at, self.buckets)
        self.weights = self._weights()

    def _send(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.few else df

    def _weights(self) -> DataFrame:
        """``request_id, query_idx, token, w``: what a posting's share is multiplied with; from counts alone, no postings are opened."""
        tokens = self._send(self._asked.select("token").distinct())
        had = self.postings.select("token", "n").join(tokens, "token", "left_semi")
        gone = self.store.read("removed", self.at, self.buckets)
        if gone is not None:
            had = had.unionByName(gone.select("token", (-F.col("n")).alias("n")).join(tokens, "token", "left_semi"))
        df = had.groupBy("token").agg(F.sum("n").alias("df"))
        idf = F.log(1 + (self.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return self._asked.join(self._send(df), "token").select(*self.keys, "token", (idf * F.col("qtf")).alias("w"))

    @property
    def bounds(self) -> DataFrame:
        """``request_id, query_idx, range, most``: no passage of the range scores more."""
        heads = self.postings.select("token", "range", "max_tf", "min_dl").join(self._send(self.weights), "token")
        of_token = heads.groupBy(*self.keys, "range", "token").agg(F.max(F.col("w") * _impact(F.col("max_tf"), F.col("min_dl"), self.avgdl)).alias("most"))
        return of_token.groupBy(*self.keys, "range").agg(F.sum("most").alias("most"))

    def _scores(self, ranges: DataFrame) -> DataFrame:
        """Exact scores of the passages of some ranges of each query."""
        wanted = ranges.select(*self.keys, "range").join(self._send(self.weights), self.keys)
        rows = self.postings.select("token", "range", "docs").join(self._send(wanted) if self.few else wanted, ["token", "range"])
        rows = _live(self.store, self.at, rows)
        scored = rows.groupBy(*self.keys, "corpus_idx").agg(F.round(F.sum(_impact(F.col("tf"), F.col("dl"), self.avgdl) * F.col("w")), 9).alias("score"))
        return scored.where("score > 0")

    @property
    def opened(self) -> DataFrame:
        """The ranges that are scored: those that may hold one of the ``k`` best."""
        bounds = self.bounds
        first = retrieval.top(bounds, self.keys, "most", FIRST, "range")
        beaten = retrieval.top(self._scores(first), self.keys, "score", self.k).where(F.col("rank") == self.k).select(*self.keys, F.col("score").alias("least"))
        # scores are rounded, bounds are not
        return bounds.join(beaten, self.keys, "left").where("most + 1e-8 >= coalesce(least, 0)")

    @property
    def top(self) -> DataFrame:
        """As :func:`specaudit.operators.retrieval.bm25`."""
        return retrieval.top(self._scores(self.opened), self.keys, "score", self.k)


def bm25(store: Store, queries: DataFrame, k: int, at: Snapshot | None = None) -> DataFrame:
    """``request_id, query_idx, corpus_idx, score, rank``: the top ``k`` of each query with positive scores, from the stored index."""
    return Search(store, queries, k, at).top
