"""Bounded-space online best-fit packing of documents into sequences of fixed length.

Documents longer than a sequence are cut into full pieces and a rest; nothing else is cut.
Each task packs the pieces it reads, in order, into at most ``open_bins`` open bins.  A
bitset keyed by free space finds the fullest bin that still takes a piece in a few word
operations.  When a new bin is needed and all are open, the fullest closes.

The bins still open when a task ends are items of a second round: ``fan_in`` tasks' bins at a
time come in order of task and bin and are packed by the same rule into as many open bins, so tasks leave few half-empty
sequences behind, however many there are.  Sequences are numbered ``task << 33 | bin``; those of the second round are negative.

Defined cases: a null text counts as empty and gives the end id alone; rows with a null id
are packed like others; repeated rows are packed each; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specaudit.llm.common import keyed_text, materialize
from specaudit.llm.pieces import MEMO_WORDS, encoder, text_slices

OPEN_BINS = 512
FAN_IN = 64


class BestFit:
    """Open bins by free space.  ``put`` gives the bin of an item and its offset there."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0  # bit f is set if a bin with f free places is open
        self.open = 0
        self.bins = 0

    def _take(self, space: int) -> int:
        own = self.free[space]
        bin_ = own.pop()
        if not own:
            self.bits &= ~(1 << space)
        self.open -= 1
        return bin_

    def _keep(self, bin_: int, space: int) -> None:
        if space:
            self.free[space].append(bin_)
            self.bits |= 1 << space
            self.open += 1

    def put(self, size: int) -> tuple[int, int]:
        fits = self.bits >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            bin_ = self._take(space)
        else:
            if self.open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            bin_, space = self.bins, self.capacity
            self.bins += 1
        self._keep(bin_, space - size)
        return bin_, self.capacity - space

    def left_open(self) -> list[tuple[int, int]]:
        """Bins still open, with what they hold."""
        return [(b, self.capacity - space) for space, own in enumerate(self.free) for b in own]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, bin long, offset long, tail boolean, used long"
KINDS = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "task": pa.int32(), "bin": pa.int64(), "offset": pa.int64(), "tail": pa.bool_(), "used": pa.int64()}


def _pack(vocabulary: str, capacity: int, end_id: int, open_bins: int, memo_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, task = BestFit(capacity, open_bins), 0
        #: rows of bins that are open, and so may be packed again
        held: dict[int, list[tuple]] = {}

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(KINDS.values())], names=list(KINDS))

        for batch in batches:
            if not batch.num_rows:
                continue
            code = encoder(vocabulary, False, memo_words)
            task = batch.column("task")[0].as_py()
            doc_ids = batch.column("doc_id").to_pylist()
            done: list[tuple] = []
            for first, texts in text_slices(batch.column("text")):
                ids, sizes = code.encode_column(texts)
                upto = np.cumsum(sizes + 1)
                # the end id behind each document
                ids = np.insert(ids, upto - 1 - np.arange(len(upto)), end_id).astype("<u4")
                for k, (end, size) in enumerate(zip(upto.tolist(), sizes.tolist(), strict=True)):
                    for piece, at in enumerate(range(0, size + 1, capacity)):
                        own = ids[end - size - 1 + at : min(end, end - size - 1 + at + capacity)]
                        n = len(own)
                        row = (doc_ids[first + k], piece, at, n, zlib.crc32(own), task)
                        if n == capacity:
                            done.append((*row, fit.bins, 0, False, n))
                            fit.bins += 1
                        else:
                            bin_, offset = fit.put(n)
                            held.setdefault(bin_, []).append((*row, bin_, offset))
            still = dict(fit.left_open())
            for bin_ in [b for b in held if b not in still]:
                done += [(*r, False, 0) for r in held.pop(bin_)]
            if done:
                yield batch_of(done)
        rest = [(*r, True, used) for b, used in fit.left_open() for r in held[b]]
        for k in range(0, len(rest), 10_000):
            yield batch_of(rest[k : k + 10_000])

    return run


def _repack(capacity: int, open_bins: int):
    """Bins that tasks left open become the items, in order of task and bin."""

    def run(key, table):  # unannotated: Spark infers the kind of function from annotations
        fit = BestFit(capacity, open_bins)
        rows = sorted(zip(table.column("task").to_pylist(), table.column("bin").to_pylist(), table.column("used").to_pylist(), strict=True))
        put = [fit.put(used) for _, _, used in rows]
        return pa.table({"task": pa.array([r[0] for r in rows], pa.int32()), "bin": pa.array([r[1] for r in rows], pa.int64()), "sequence_id": pa.array([-1 - ((key[0].as_py() << 33) | p[0]) for p in put], pa.int64()), "base": pa.array([p[1] for p in put], pa.int64())})

    return run


def pack(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 2048, end_id: int = 0, open_bins: int = OPEN_BINS, fan_in: int = FAN_IN, memo_words: int = MEMO_WORDS) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, one row a piece.  ``memo_words`` bounds a worker's memo of encoded words"""
    docs = keyed_text(df, id_col, text_col).withColumn("task", F.spark_partition_id())
    pieces = materialize(docs.mapInArrow(_pack(vocabulary, capacity, end_id, open_bins, memo_words), PIECES), "packing-pieces")
    tails = pieces.where("tail")
    bins = tails.select("task", "bin", "used").distinct().withColumn("grp", F.expr(f"cast(task div {fan_in} as long)"))
    again = bins.groupBy("grp").applyInArrow(_repack(capacity, open_bins), "task int, bin long, sequence_id long, base long")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    closed = pieces.where("not tail").select(*columns, F.expr("shiftleft(cast(task as bigint), 33) | bin").alias("sequence_id"), "offset")
    moved = tails.join(again, ["task", "bin"]).select(*columns, "sequence_id", (F.col("base") + F.col("offset")).alias("offset"))
    return closed.unionByName(moved)
