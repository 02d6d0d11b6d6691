"""Exact dedup by composable polynomial fingerprints.

A text is normalised by deleting ASCII white space and read as UTF-8 bytes
``b1..bn``.  Its fingerprint modulo a prime p is ``sum(b_i * r**(n-i)) mod p``.
Fingerprints compose: ``F(XY) = F(X) * r**len(Y) + F(Y)``, so chunks can be hashed in
any place and order and be put together by length-shifted sums.  Four 31-bit primes
give 124 bits; the length is part of the key.

A text of one chunk is hashed where it is read; chunks of longer ones are rows of their own, dealt to all tasks, and
one short row a chunk is summed into the fingerprint, so the longest text costs no task more than its chunks' hashes.

Equal fingerprints are no proof, so the texts of groups are compared chunk by chunk: for each key and chunk number Spark
streams the chunks into their least and greatest, on each task first, and a key is refuted where these differ.  A hot group leaves each task
as two chunks a number.  Texts are hashed once: their chunks are written beside the hashes and only those of groups are read again.
A key with unequal texts (never seen with four primes) is regrouped by the texts' digests.

Defined cases: a null text counts as empty; all texts without a visible character are
equal; rows with a null id take part and lose ties to any other id; repeated rows (same id and text) form a group of which one
row stays; an empty table gives an empty result; other columns of the input, whatever
their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specaudit.llm.common import SPACES, discard, keyed_text, materialize

#: Four primes below 2**31 and a base for each.
MODULI = ((2147483647, 1103515245), (2147483629, 742938285), (2147483587, 950706376), (2147483579, 1226874159))
#: Bytes in a chunk: 2**16 products under 2**39 add up to less than 2**63.
CHUNK = 1 << 16
#: Chunks of a long text that stay together.
SPAN = 64


class Polynomial:
    """Fingerprints of byte strings by chunks."""

    def __init__(self, moduli: tuple[tuple[int, int], ...] = MODULI, chunk: int = CHUNK):
        self.moduli, self.chunk = moduli, chunk
        self.powers = []
        for p, r in moduli:
            # r**0 .. r**(chunk-1), by doubling
            pw = np.ones(1, np.uint64)
            while len(pw) < chunk:
                pw = np.concatenate([pw, pw * np.uint64(pow(r, len(pw), p)) % np.uint64(p)])
            self.powers.append(np.ascontiguousarray(pw[:chunk][::-1]))

    def of_chunk(self, data: bytes) -> tuple[int, ...]:
        b = np.frombuffer(data, np.uint8).astype(np.uint64)
        n = len(b)
        return tuple(int(b @ pw[self.chunk - n :]) % p if n else 0 for (p, _), pw in zip(self.moduli, self.powers, strict=True))

    def shift(self, h: tuple[int, ...], n: int) -> tuple[int, ...]:
        """The share of a chunk that ``n`` bytes follow."""
        return tuple(x * pow(r, n, p) % p for x, (p, r) in zip(h, self.moduli, strict=True))

    def join(self, left: tuple[int, ...], right: tuple[int, ...], n_right: int) -> tuple[int, ...]:
        return tuple((x + y) % p for x, y, (p, _) in zip(self.shift(left, n_right), right, self.moduli, strict=True))

    def of(self, data: bytes) -> tuple[int, ...]:
        h = (0,) * len(self.moduli)
        for k in range(0, len(data), self.chunk):
            part = data[k : k + self.chunk]
            h = self.join(h, self.of_chunk(part), len(part))
        return h


def packed(h: tuple[int, ...]) -> tuple[int, int]:
    """Residues as two non-negative 62-bit numbers."""
    h = (*h, 0, 0, 0, 0)[:4]
    return h[0] << 31 | h[1], h[2] << 31 | h[3]


KEY = ["f1", "f2", "n_bytes"]
FINGERPRINT = "f1 long, f2 long, n_bytes long"


CHUNKS = f"rid long, doc_id long, n_cp long, text_sha256 string, k int, piece string, {FINGERPRINT}, h array<long>"


def _hashed(moduli, chunk: int):
    """Rows of chunks to the same with the chunk's own fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly = Polynomial(moduli, chunk)
        for batch in batches:
            data = [x.as_py().encode("utf-8", "surrogatepass") for x in batch.column("piece")]
            own = [poly.of_chunk(x) for x in data]
            keys = [packed(x) for x in own]
            more = [pa.array([x[0] for x in keys], pa.int64()), pa.array([x[1] for x in keys], pa.int64()), pa.array([len(x) for x in data], pa.int64()), pa.array([list(x) for x in own], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "f1", "f2", "n_bytes", "h"])

    return run


def _cut(step: int):
    """Long texts to rows of their chunks, a bounded number at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                rid, doc_id, n_cp, sha, text = (batch.column(k)[row].as_py() for k in range(5))
                for first in range(0, len(text), step * SPAN):
                    pieces = [text[at : at + step] for at in range(first, min(len(text), first + step * SPAN), step)]
                    n = len(pieces)
                    kinds = ((rid, pa.int64()), (doc_id, pa.int64()), (n_cp, pa.int64()), (sha, pa.string()))
                    yield pa.RecordBatch.from_arrays([*(pa.array([v] * n, t) for v, t in kinds), pa.array(range(first // step, first // step + n), pa.int32()), pa.array(pieces, pa.string())], names=["rid", "doc_id", "n_cp", "text_sha256", "k", "piece"])

    return run


def _summed(moduli, chunk: int):
    """A text's chunks in order to its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly = Polynomial(moduli, chunk)
        for batch in batches:
            out = {"rid": [], "f1": [], "f2": [], "n_bytes": []}
            for rid, parts in zip(batch.column("rid").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                h, n = (0,) * len(moduli), 0
                for part in parts:
                    h, n = poly.join(h, tuple(part["h"]), part["n_bytes"]), n + part["n_bytes"]
                for k, v in zip(out, (rid, *packed(h), n), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return run


def hashed_chunks(docs: DataFrame, moduli=MODULI, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, text) to a row for each chunk; texts of several chunks have a negative ``rid``, and their chunks are dealt to all tasks."""
    step = chunk // 4  # at most four bytes a code point
    bare = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), SPACES.decode(), F.col("text"))
    rows = docs.select("doc_id", F.length("text").cast("long").alias("n_cp"), bare.alias("bare")).withColumn("n", F.floor(F.greatest(F.length("bare") - 1, F.lit(0)) / step).cast("int"))
    rows = rows.withColumn("rid", F.monotonically_increasing_id()).withColumn("text_sha256", F.sha2("bare", 256))
    # the raw length tells most texts apart without deleting anything
    single = rows.where(f"n_cp <= {step} or n = 0").select("rid", "doc_id", "n_cp", "text_sha256", F.lit(0).alias("k"), F.col("bare").alias("piece"))
    long = rows.where(f"n_cp > {step} and n > 0").select((-1 - F.col("rid")).alias("rid"), "doc_id", "n_cp", "text_sha256", "bare")
    several = long.mapInArrow(_cut(step), "rid long, doc_id long, n_cp long, text_sha256 string, k int, piece string")
    parts = (single, several.repartition("rid", "k"))
    one, more = (x.mapInArrow(_hashed(moduli, chunk), CHUNKS) for x in parts)
    return materialize(one.unionByName(more), "exact-dedup-chunks")


def fingerprints(chunks: DataFrame, moduli=MODULI, chunk: int = CHUNK) -> DataFrame:
    """One row for each text: ``rid, doc_id, n_cp, text_sha256`` and its fingerprint."""
    about = ["rid", "doc_id", "n_cp", "text_sha256"]
    single = chunks.where("rid >= 0").select(*about, *KEY)
    # one short row a chunk: 40 bytes for 16 Ki code points of text
    parts = chunks.where("rid < 0").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("k", "n_bytes", "h"))).alias("parts"))
    long = chunks.where("rid < 0 and k = 0").select(*about).join(parts.mapInArrow(_summed(moduli, chunk), f"rid long, {FINGERPRINT}"), "rid")
    return materialize(single.unionByName(long), "exact-dedup-rows")


def unequal_keys(chunks: DataFrame, rows: DataFrame, groups: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Fingerprints of ``groups`` under which the chunks are not all equal, number by number."""
    single = chunks.where("rid >= 0").select(*KEY, "k", "piece").join(groups, KEY, "left_semi")
    # a long text meets its key in spans of chunks, on as many tasks; its bytes bound their number
    spans = F.explode(F.sequence(F.lit(0), F.floor(F.col("n_bytes") / (chunk // 4 * SPAN)).cast("int"))).alias("span")
    members = rows.where("rid < 0").join(groups, KEY, "left_semi").select("rid", spans, *KEY)
    long = chunks.where("rid < 0").select("rid", F.expr(f"k div {SPAN}").cast("int").alias("span"), "k", "piece").join(members, ["rid", "span"]).select(*KEY, "k", "piece")
    ends = single.unionByName(long).groupBy(*KEY, "k").agg(F.min("piece").alias("low"), F.max("piece").alias("high"))
    return ends.where("low <> high").select(*KEY).distinct()


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, moduli=MODULI, chunk: int = CHUNK) -> DataFrame:
    """One row for each row of ``df``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of rows with equal normalised texts the one with the most code points stays, then the
    one with the smallest id.
    """
    chunks = hashed_chunks(keyed_text(df, id_col, text_col), moduli, chunk)
    rows = fingerprints(chunks, moduli, chunk)
    groups = materialize(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("members")).where("members > 1").select(*KEY), "exact-dedup-groups")
    bad = materialize(unequal_keys(chunks, rows, groups, chunk), "exact-dedup-unequal")
    discard(chunks, groups)
    klass = [*KEY, "part"]
    if bad.limit(1).count():
        # regroup by the texts: the digest stands for a text whose fingerprint collided
        rows = rows.join(bad.withColumn("bad", F.lit(True)), KEY, "left").withColumn("part", F.when(F.col("bad"), F.col("text_sha256")).otherwise(F.lit(""))).drop("bad")
    else:
        rows = rows.withColumn("part", F.lit(""))
    best = rows.groupBy(*klass).agg(F.min(F.struct((-F.col("n_cp")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("rid").alias("d"))).alias("best"), F.count(F.lit(1)).alias("group_size"))
    out = rows.join(best, klass)
    return out.select("doc_id", F.col("best.c").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.d")).alias("kept"), "text_sha256")
