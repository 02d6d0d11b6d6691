"""A stored approximate index of unit vectors: coarse cells, product codes, exact scores at the end.

A quantiser is fitted on a bounded sample: ``cells`` centroids, and for the residual of a vector from its centroid a book of up to 256
codewords for each of its ``parts``.  Every vector is stored in its cell's bucket with its code, a byte a part; cells share at most 64 buckets,
so that an index of a thousand cells isn't thousands of small files.

How many cells a search must read depends on the data, so it is measured when the quantiser is fitted: few where vectors stand in
clusters, most of them where directions are random.

A search ranks the centroids of its queries, reads the codes of the ``probes`` best cells (a partition filter on their buckets, and no vectors), adds up
looked-up products to an approximate score, keeps a shortlist of each query on each task and then of all, joins it with the vectors of
the same cells and scores those exactly.  All cells and no shortlist is :func:`specaudit.operators.retrieval.dense`.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specaudit.operators import retrieval
from specaudit.operators.inverted import without_gone
from specaudit.operators.retrieval import HITS, QUERY_BLOCK, keep_best
from specaudit.sources.versions import BUCKETS, Change, Snapshot, Store

#: Rows (those of the least hashes) that a quantiser is fitted on, and rows of the sample for each cell at least.
SAMPLE, PER_CELL = 40_000, 30
MOST_CELLS, WORDS = 1024, 256
#: Numbers of a vector that one byte of its code stands for.
PART_LENGTH = 4
#: Approximate ranks that are scored exactly, as a multiple of ``k``.
SHORTLIST = 8
#: A quantiser's own number of probes is the least that finds this share of the ``NEAR`` nearest rows of the sample, for ``TRIALS`` rows of it.
RECALL, NEAR, TRIALS = 0.97, 28, 200


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 5) -> np.ndarray:
    """Lloyd's centroids; an empty one moves to the row that fits worst."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        far = np.concatenate([((b**2).sum(1)[:, None] - 2 * b @ c.T + (c**2).sum(1)) for b in np.array_split(x, max(1, len(x) // 4096))])
        own, worst = far.argmin(1), far.min(1)
        for j in range(len(c)):
            rows = x[own == j]
            if len(rows):
                c[j] = rows.mean(0)
            else:
                c[j] = x[worst.argmax()]
                worst[worst.argmax()] = -np.inf
    return c


@dataclass
class Quantiser:
    centroids: np.ndarray
    books: list[np.ndarray]
    edges: np.ndarray
    probes: int = 1

    @classmethod
    def fit(cls, x: np.ndarray, cells: int) -> Quantiser:
        centroids = kmeans(x, cells)
        rest = x - centroids[cls.cell(centroids, x)]
        edges = np.linspace(0, x.shape[1], max(1, x.shape[1] // PART_LENGTH) + 1).astype(int)
        return cls(centroids, [kmeans(rest[:, a:b], WORDS) for a, b in zip(edges[:-1], edges[1:], strict=True)], edges, cls.probes_for(centroids, x))

    @classmethod
    def probes_for(cls, centroids: np.ndarray, x: np.ndarray) -> int:
        """The least number of cells that hold ``RECALL`` of the nearest rows of some rows."""
        q = x[np.linspace(0, len(x) - 1, min(TRIALS, len(x))).astype(int)]
        near = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :NEAR]
        place = np.argsort(np.argsort(-(q @ centroids.T), axis=1, kind="stable"), axis=1)
        places = np.sort(np.take_along_axis(place, cls.cell(centroids, x)[near], axis=1).ravel())
        return int(places[min(len(places) - 1, int(np.ceil(RECALL * len(places))))]) + 1

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, centroids=self.centroids, edges=self.edges, probes=self.probes, **{f"book{m}": b for m, b in enumerate(self.books)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, body: bytes) -> Quantiser:
        got = np.load(io.BytesIO(body))
        return cls(got["centroids"], [got[f"book{m}"] for m in range(len(got["edges"]) - 1)], got["edges"], int(got["probes"]))

    @staticmethod
    def cell(c: np.ndarray, x: np.ndarray) -> np.ndarray:
        return ((c**2).sum(1) - 2 * x @ c.T).argmin(1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = self.cell(self.centroids, x)
        rest = x - self.centroids[cell]
        return cell, np.stack([self.cell(book, rest[:, a:b]) for book, a, b in zip(self.books, self.edges[:-1], self.edges[1:], strict=True)], axis=1).astype(np.uint8)

    def products(self, q: np.ndarray) -> np.ndarray:
        """Products of queries with all codewords: [query, part, word]."""
        out = np.zeros((len(q), len(self.books), WORDS))
        for m, book in enumerate(self.books):
            out[:, m, : len(book)] = q[:, self.edges[m] : self.edges[m + 1]] @ book.T
        return out


def _unit_rows(vectors: DataFrame, id_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).cast("long").alias("corpus_idx"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def create(change: Change, vectors: DataFrame, id_col: str = "corpus_idx", cells: int | None = None) -> None:
    """Fit a quantiser and store every vector.  All vectors have one length."""
    own = _unit_rows(vectors, id_col)
    # rows that can't be among the least hashes stay on their tasks
    n, least = own.count(), F.xxhash64("corpus_idx")
    few = own.where(least < int(-(2**63) + 2**64 * 1.2 * SAMPLE / n)) if n > 2 * SAMPLE else own
    sample = [r[0] for r in few.orderBy(least).select("embedding").limit(SAMPLE).collect()]
    if len(sample) < min(n, SAMPLE):
        sample = [r[0] for r in own.orderBy(least).select("embedding").limit(SAMPLE).collect()]
    if not sample:
        return
    cells = cells or max(1, min(MOST_CELLS, len(sample) // PER_CELL))
    fitted = Quantiser.fit(np.array(sample), cells)
    spark = vectors.sparkSession
    change.replace("quantiser", spark.createDataFrame([(0, bytearray(fitted.to_bytes()))], "id int, body binary"), "id", None, 1)
    change.drop("vectors")
    add(change, vectors, id_col, fitted)


def add(change: Change, vectors: DataFrame, id_col: str = "corpus_idx", fitted: Quantiser | None = None) -> None:
    """Store further vectors under the quantiser that is there."""
    fitted = fitted or quantiser(change.store, change.base)
    sent = vectors.sparkSession.sparkContext.broadcast(fitted)  # at most a thousand centroids and 256 words a part
    length, born = fitted.centroids.shape[1], change.number
    buckets = change.buckets("vectors", min(BUCKETS, len(fitted.centroids)))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, codes = sent.value.encode(_matrix(batch.column("embedding")))
                yield pa.RecordBatch.from_arrays([batch.column("corpus_idx"), batch.column("embedding"), pa.array(cell % buckets, pa.int32()), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([born] * len(cell), pa.int64())], names=["corpus_idx", "embedding", "bucket", "cell", "code", "born"])

    rows = _unit_rows(vectors, id_col).where(F.size("embedding") == length).mapInArrow(code, "corpus_idx long, embedding array<double>, bucket int, cell int, code binary, born long")
    change.append("vectors", rows, None, buckets)


def _cell(table: DataFrame) -> Column:
    """A stored vector's cell; indexes that were written before cells shared buckets have a bucket a cell."""
    return F.coalesce("cell", "bucket") if "cell" in table.columns else F.col("bucket")


def quantiser(store: Store, at: Snapshot) -> Quantiser:
    return Quantiser.from_bytes(bytes(store.read("quantiser", at).select("body").first()[0]))


def search(store: Store, queries: DataFrame, k: int, probes: int | None = None, shortlist: int = SHORTLIST, at: Snapshot | None = None) -> DataFrame:
    """``request_id, query_idx, corpus_idx, score, rank`` of (request_id, query_idx, query_vector): the top ``k`` that the probed cells hold.

    A block of ``QUERY_BLOCK`` queries reads the cells that any of them probes.
    """
    at = at or store.snapshot()
    spark, fitted = store.spark, quantiser(store, at)
    probes = min(probes or fitted.probes, len(fitted.centroids))
    blocks, out = max(1, -(-queries.count() // QUERY_BLOCK)), spark.createDataFrame([], HITS)
    for n in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("request_id", "query_idx"), F.lit(blocks)) == n).select("request_id", "query_idx", F.col("query_vector").cast("array<double>").alias("v"))
        rows = [r for r in own.where(F.size("v") == fitted.centroids.shape[1]).collect()]
        if not rows:
            continue
        q = np.array([r["v"] for r in rows])
        nearest = np.argsort(-(q @ fitted.centroids.T), axis=1, kind="stable")[:, :probes]
        cells = sorted(set(nearest.ravel().tolist()))
        asked = {c: np.flatnonzero((nearest == c).any(1)) for c in cells}
        sent = spark.sparkContext.broadcast((fitted, q, asked))
        buckets = at.tables["vectors"]["buckets"]
        table = without_gone(store, at, store.read("vectors", at, sorted({c % buckets for c in cells})))
        table = table.withColumn("cell", _cell(table))
        if len(cells) < len(fitted.centroids):
            table = table.where(F.col("cell").isin(*cells))
        near = retrieval.top(table.select("corpus_idx", "cell", "code").mapInArrow(_approximate(sent, shortlist * k), "query int, corpus_idx long, cell int, score double"), ["query"], "score", shortlist * k)
        named = spark.createDataFrame([(j, r["request_id"], r["query_idx"]) for j, r in enumerate(rows)], "query int, request_id string, query_idx int")
        exact = near.select("query", "cell", "corpus_idx").join(table.select("cell", "corpus_idx", "embedding"), ["cell", "corpus_idx"]).mapInArrow(_exact(sent), "query int, corpus_idx long, score double")
        out = out.unionByName(exact.join(F.broadcast(named), "query").select("request_id", "query_idx", "corpus_idx", "score"))
    return retrieval.top(out, ["request_id", "query_idx"], "score", k)


def _approximate(sent, keep: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's best ``keep`` of each query by code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, q, asked = sent.value
        products, base = fitted.products(q), q @ fitted.centroids.T
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        cell_of: dict[int, int] = {}
        for batch in batches:
            cell, ids = batch.column("cell").to_numpy(), batch.column("corpus_idx").to_numpy()
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            for c in np.unique(cell).tolist():
                mine, who = np.flatnonzero(cell == c), asked[c]
                score = base[who, c][:, None] + sum(products[who, m][:, codes[mine, m]] for m in range(codes.shape[1]))
                least = np.partition(score, -keep, axis=1)[:, -keep] if len(mine) > keep else np.full(len(who), -np.inf)
                query, row = np.nonzero(score >= least[:, None])
                cell_of.update(zip(ids[mine[np.unique(row)]].tolist(), [c] * len(mine), strict=False))
                held = keep_best(*(np.concatenate(x) for x in zip(held, (ids[mine[row]], who[query], score[query, row]), strict=True)), keep)
            if len(cell_of) > 4 * len(held[0]) + 10_000:
                cell_of = {i: cell_of[i] for i in held[0].tolist()}
        ids, which, score = held
        yield pa.RecordBatch.from_pydict({"query": pa.array(which, pa.int32()), "corpus_idx": pa.array(ids, pa.int64()), "cell": pa.array([cell_of[i] for i in ids.tolist()], pa.int32()), "score": pa.array(score, pa.float64())})

    return run


def _exact(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value[1]
        for batch in batches:
            if batch.num_rows:
                which = batch.column("query").to_numpy()
                score = np.round(np.einsum("ij,ij->i", _matrix(batch.column("embedding")), q[which]), 9)
                yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("corpus_idx"), pa.array(score)], names=["query", "corpus_idx", "score"])

    return run
