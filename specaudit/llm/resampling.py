"""Importance resampling towards a target distribution, over hashed n-grams with an integer word dictionary.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of all characters beyond ASCII; features are the runs of one and of two
words, each hashed to one of ``BUCKETS`` places.  A place's gain is the logarithm of its smoothed share of
the target over its share of the corpus, in thousandths; a document's weight is the mean gain of its features, and the draw
keeps the largest sums of weight and a Gumbel number made from the document's id.

Texts are read as one run of bytes by Arrow batch.  Each block of up to ``BLOCK`` words gets an integer dictionary: a word's
id stands for it, a pair is two ids in one integer, each distinct pair's bytes are put together and hashed once, and
counts come back to documents through the pair's number.  A dictionary of the whole corpus would send each word of each text
through a shuffle; so the dictionary is the block's, and what is added up over the corpus is the counts of places, a constant number.

The draw has no global sort in one task: scores are whole numbers between bounds that the formula gives, so a histogram finds
the cut, and the rows above it are ranked by ranges.

Defined cases: a null or empty text and one without a word have no features, weight 0 and no draw; very long texts are read
block by block; ties go to the smaller id, null ids last, and rows that share an id and a score share their ranks in any order; repeated
rows count each; an empty target gives every document the same gains; an empty table gives an empty result; other columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specaudit.llm.common import arrow_map, discard, keyed_text, materialize
from specaudit.llm.ranking import ordered, with_rank

BUCKETS = 10_000
PERCENT, LEAST_WORDS, SEED = 25, 20, 7
#: Words of a block, whose dictionary and distinct pairs a worker holds.
BLOCK = 1 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased bytes of a batch's texts as one run, and the n+1 places where texts begin and end."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = memoryview(data)[ends[0] : ends[-1]] if data is not None and len(column) else b""
    return np.frombuffer(bytes(raw).translate(_LOWER), np.uint8), ends - ends[0] if len(ends) else np.zeros(1, np.int64)


def _hashed(words: pa.Array, buckets: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) % buckets for w in words.to_pylist()), np.int64, len(words))


def features(column: pa.Array, buckets: int = BUCKETS, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, bucket, count) of the distinct features of each block of a batch of texts; words and pairs come apart."""
    data, ends = _bytes(column)
    word = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    first = np.flatnonzero(word & (edge[:-1] | ~np.concatenate([[False], word[:-1]])))
    stop = np.flatnonzero(word & (edge[1:] | ~np.concatenate([word[1:], [False]]))) + 1
    row = np.searchsorted(ends, first, side="right") - 1
    for at in range(0, len(first), block):
        # the word before the block makes its first pair
        a, b = max(0, at - 1), min(len(first), at + block)
        span, size = slice(first[a], stop[b - 1]), stop[a:b] - first[a:b]
        offsets = np.zeros(b - a + 1, np.int64)
        np.cumsum(size, out=offsets[1:])
        own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(data[span][word[span]].tobytes())])
        coded = own.dictionary_encode()
        ids, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        new = slice(at - a, None)
        yield _counted(row[a:b][new], ids[new], _hashed(names, buckets))
        same = row[a + 1 : b] == row[a : b - 1]
        pairs = pa.array((ids[:-1] << 32 | ids[1:])[same]).dictionary_encode()
        left, right = (names.take(pa.array(x)) for x in np.divmod(pairs.dictionary.to_numpy(), 1 << 32))
        joined = pc.binary_join_element_wise(left, right, pa.scalar(b" ", pa.large_binary()))
        yield _counted(row[a + 1 : b][same], pairs.indices.to_numpy().astype(np.int64), _hashed(joined, buckets))


def _counted(row: np.ndarray, feature: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of distinct (row, feature), with the feature's bucket."""
    key, n = np.unique(row << 32 | feature, return_counts=True)
    return key >> 32, bucket[key & 0xFFFFFFFF], n


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: how many features of all texts fall in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, bucket, n in features(batch.column("text"), buckets):
                np.add.at(total, bucket, n)
        (used,) = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32()), "n": pa.array(total[used], pa.int64())})

    return texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain in thousandths, from two tables of :func:`bucket_counts`: at most ``buckets`` rows reach the driver."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for out, counts in ((s, corpus), (t, target)):
        for r in counts.collect():
            out[r["bucket"]] = r["n"]
    s_all, t_all = float(s.sum()), float(t.sum())
    return np.array([math.floor(1000 * math.log((t[k] + 1) * (s_all + buckets) / ((s[k] + 1) * (t_all + buckets)))) for k in range(buckets)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of (doc_id, text)."""
    buckets = len(gain)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, total, sums = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
        for k, (row, bucket, n) in enumerate(features(batch.column("text"), buckets)):
            np.add.at(total, row, n)
            np.add.at(sums, row, n * gain[bucket])
            if k % 2 == 0:
                np.add.at(words, row, n)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (words, total, np.floor_divide(sums, np.maximum(1, total))))], names=["doc_id", "n_words", "n_features", "weight"])

    return arrow_map(docs, score, "doc_id long, n_words long, n_features long, weight long")


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, target_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; ``rank`` counts the drawn ones from 1."""
    docs = keyed_text(df, id_col, text_col)
    aim = target.select(F.coalesce(target[target_col].cast("string"), F.lit("")).alias("text"))
    gain = gains(bucket_counts(docs, buckets), bucket_counts(aim, buckets), buckets)
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((draw + 0.5) / 4294967296.0)))
    scored = materialize(weights(docs, gain).withColumn("score", F.col("weight") + gumbel.cast("long")), "resample-scores")
    fit = scored.where(F.col("n_words") >= least_words)
    # a score is a whole number: gains lie within 1000 * ln(2**64) of 0 and Gumbel numbers between -3,200 and 22,900, so the histogram is bounded
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = materialize(fit.groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(above)), "resample-histogram")
    n = steps.agg(F.sum("n")).first()[0] or 0
    take = percent * n // 100
    cut = steps.where(F.col("upto") >= take).agg(F.max("score")).first()[0] if take else None
    chosen = (F.col("n_words") >= least_words) & (F.col("score") >= cut) if take else F.lit(False)
    best = with_rank(ordered(scored.where(chosen), F.desc("score"), F.col("doc_id").asc_nulls_last(), label="resample-ranks"), "place")
    rank = F.when(F.col("place") < take, F.col("place") + 1)
    discard(steps)
    columns = ["doc_id", "n_features", "weight", "score"]
    return best.select(*columns, rank.alias("rank")).unionByName(scored.where(~chosen).select(*columns, F.lit(None).cast("long").alias("rank")))
