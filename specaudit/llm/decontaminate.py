"""Benchmark decontamination: BM25 over an inverted index of test items with block-max bounds.

Test items are the indexed documents; every passage of every training text is a query.
Scores are BM25 sums over the distinct terms of a passage, divided by the item's own score
(a passage that holds the whole item scores 1).  Document frequencies and the mean length are those of the whole benchmark.
Items are dealt to blocks; a term's postings list the blocks it occurs in with its largest impact there.  A passage is dropped when
the sum of its terms' largest impacts is below the threshold; then its terms' block postings are added up, and blocks below are
dropped; items of the blocks left are scored exactly and all above the threshold are retrieved.

Retrieved pairs are verified by shingles of five words: a text is contaminated by an item
if a passage holds 0.8 of the item's shingles, or 0.8 of its question's and half of its answer's
(the last sentence; an item of one sentence has no answer).

A passage is two strides of words and starts at every stride, and a stride is as long as the longest item of an index,
so any place an item can stand in lies within one passage.  Items are indexed with others of about their length, so a long one
doesn't stretch the passages of short ones, and in shards of at most ``SHARD_WORDS`` benchmark words, so that what is broadcast
for one pass over the texts is bounded however large the benchmark is; more words take more passes.

Defined cases: null texts and items count as empty, and an item without a word matches nothing;
items of fewer than five words are one shingle; repeated items and rows are reported each; long texts are read whole;
empty tables give empty results; other columns, whatever their names, pass through :func:`drop_contaminated`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specaudit.llm.common import arrow_map, materialize, small_batches

K1, B = 1.2, 0.75
THRESHOLD = 0.5
OVERLAP, ANSWER_OVERLAP = 0.8, 0.5
SHINGLE = 5
BLOCK = 8
SHARD_WORDS = 200_000
LEAST_STRIDE = 64
#: Letters, digits and other scripts' bytes make words.
WORD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(WORD).split()


def shingles(words: list[bytes], n: int = SHINGLE) -> set[bytes]:
    return {b" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def question_and_answer(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """Words of all but the last sentence, and of the last; all are the question if there is one sentence."""
    parts = [w for w in map(words_of, re.split(r"(?<=[.!?])\s+", (text or "").strip())) if w]
    if len(parts) < 2:
        return words_of(text), []
    return [w for p in parts[:-1] for w in p], parts[-1]


class Index:
    """Postings of items, by item and by block.

    about: the number of items of the whole benchmark, their mean length, and in how many each term occurs; the given items' own by default.
    """

    def __init__(self, items: list[tuple[int | None, str | None]], about: tuple[int, float, dict[bytes, int]] | None = None):
        items = [(i, t) for i, t in items if words_of(t)]
        self.ids = [i for i, _ in items]
        bags = [Counter(words_of(t)) for _, t in items]
        lengths = [sum(b.values()) for b in bags]
        total, mean, df = about or (len(items), sum(lengths) / max(1, len(items)), Counter(w for b in bags for w in b))
        self.vocabulary: dict[bytes, int] = {w: k for k, w in enumerate(sorted(set().union(*bags)))}
        idf = {w: np.log(1 + (total - df[w] + 0.5) / (df[w] + 0.5)) for w in self.vocabulary}
        self.blocks = -(-len(items) // BLOCK)
        self.postings: list[tuple[np.ndarray, np.ndarray]] = []
        self.parts = []
        for (_, text), bag, length in zip(items, bags, lengths, strict=True):
            norm = K1 * (1 - B + B * length / max(1.0, mean))
            terms = np.array([self.vocabulary[w] for w in bag])
            impact = np.array([idf[w] * f * (K1 + 1) / (f + norm) for w, f in bag.items()])
            order = np.argsort(terms)
            self.postings.append((terms[order], (impact / impact.sum())[order]))
            q, a = question_and_answer(text)
            self.parts.append((shingles(words_of(text)), shingles(q), shingles(a)))
        #: each block's terms, and their impacts on its items
        self.block_items: list[tuple[np.ndarray, np.ndarray]] = []
        of_term, of_block, largest = [], [], []
        for b in range(self.blocks):
            own = self.postings[b * BLOCK : (b + 1) * BLOCK]
            terms = np.unique(np.concatenate([t for t, _ in own]))
            weights = np.zeros((len(own), len(terms)))
            for k, (t, w) in enumerate(own):
                weights[k, np.searchsorted(terms, t)] = w
            self.block_items.append((terms, weights))
            of_term.append(terms)
            of_block.append(np.full(len(terms), b))
            largest.append(weights.max(axis=0))
        # postings by term: blocks and the largest impact in each; the place behind the last term is that of unknown words
        term = np.concatenate(of_term) if of_term else np.zeros(0, np.int64)
        order = np.argsort(term, kind="stable")
        self.begin = np.searchsorted(term[order], np.arange(len(self.vocabulary) + 2))
        self.block_of = np.concatenate(of_block)[order] if of_block else np.zeros(0, np.int64)
        self.block_max = np.concatenate(largest)[order] if largest else np.zeros(0)
        self.term_max = np.zeros(len(self.vocabulary) + 1)
        if len(term):
            np.maximum.at(self.term_max, term[order], self.block_max)
        self.stride = max(LEAST_STRIDE, max(lengths, default=0))

    def retrieve(self, words: list[bytes], threshold: float = THRESHOLD) -> list[tuple[int, int, float]]:
        """``passage, item, score`` of all pairs at or above the threshold; passage p starts at word ``p * stride``."""
        step, none = self.stride, len(self.vocabulary)
        ids = np.array(list(map(self.vocabulary.get, words, repeat(none))), np.int64)
        at = np.flatnonzero(ids != none)
        if not len(at):
            return []
        # distinct terms of each stride, then of each passage that the sum of largest impacts lets live
        pairs = np.unique((at // step) * (none + 1) + ids[at])
        seg, term = pairs // (none + 1), pairs % (none + 1)
        own = np.bincount(seg, weights=self.term_max[term], minlength=-(-len(words) // step) + 1)
        slack = threshold - 1e-6
        live = np.zeros(len(own) + 1, bool)
        live[:-2] = own[:-1] + own[1:] >= slack
        # a stride belongs to the passage that it begins and to the one before
        passage = np.concatenate([seg, seg - 1])
        term = np.concatenate([term, term])
        stay = live[passage]  # passage -1 looks at the last place, which is never live
        if not stay.any():
            return []
        pairs = np.unique(passage[stay] * (none + 1) + term[stay])
        passage, term = pairs // (none + 1), pairs % (none + 1)
        n = self.begin[term + 1] - self.begin[term]
        upto = np.cumsum(n)
        post = np.repeat(self.begin[term] - upto + n, n) + np.arange(int(upto[-1]))
        key, which = np.unique(np.repeat(passage, n) * self.blocks + self.block_of[post], return_inverse=True)
        bound = np.bincount(which, weights=self.block_max[post])
        found = []
        present = np.zeros(none + 1)
        first = np.searchsorted(passage, np.arange(int(passage[-1]) + 2))
        last = -1
        for k in key[bound >= slack].tolist():
            p, b = divmod(k, self.blocks)
            if p != last:
                present[:] = 0
                present[term[first[p] : first[p + 1]]] = 1
                last = p
            terms, weights = self.block_items[b]
            scores = weights @ present[terms]
            found += [(p, b * BLOCK + j, float(scores[j])) for j in np.flatnonzero(scores >= threshold).tolist()]
        return found

    def matches(self, words: list[bytes], threshold: float = THRESHOLD) -> list[tuple[int | None, float, float, float, float]]:
        """``item, score, overlap, question overlap, answer overlap`` of each contaminating item: those of its best passage."""
        best: dict[int, tuple] = {}
        at, held, line = -1, set(), b""
        for p, k, score in self.retrieve(words, threshold):
            if p != at:
                own = words[p * self.stride : (p + 2) * self.stride]
                at, held, line = p, shingles(own), b" " + b" ".join(own) + b" "
            whole, q, a = (self.share(x, held, line) for x in self.parts[k])
            if whole >= OVERLAP or (q >= OVERLAP and a >= ANSWER_OVERLAP):
                best[k] = max(best.get(k, (0.0,)), (whole, q, a, score))
        return [(self.ids[k], s, w, q, a) for k, (w, q, a, s) in sorted(best.items())]

    @staticmethod
    def share(part: set[bytes], held: set[bytes], line: bytes) -> float:
        """Share of a part's shingles that a passage holds; a part of fewer than five words is looked for as it is."""
        if len(part) == 1:
            (only,) = part
            return float(b" " + only + b" " in line)
        return len(part & held) / len(part) if part else 0.0


def length_class(n_words: int) -> int:
    """0 up to ``LEAST_STRIDE`` words, and one more for each doubling."""
    return max(0, (n_words - 1) // LEAST_STRIDE).bit_length()


def passes(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", shard_words: int = SHARD_WORDS) -> Iterator[list[Index]]:
    """Indexes over all items, as many at a time as hold about ``shard_words`` words; the driver holds no more than that."""
    items = benchmark.select(benchmark[item_col].cast("long").alias("item_id"), F.coalesce(benchmark[text_col].cast("string"), F.lit("")).alias("text"))

    def sized(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = [len(words_of(t)) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array([length_class(x) for x in n], pa.int32())], names=["item_id", "text", "n_words", "class"])

    def terms(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"term": pa.array([w for t in batch.column("text").to_pylist() for w in set(words_of(t))], pa.binary())})

    items = materialize(arrow_map(items, sized, "item_id long, text string, n_words long, class int").where("n_words > 0"), "benchmark-items")
    df = materialize(arrow_map(items.select("text"), terms, "term binary").groupBy("term").agg(F.count(F.lit(1)).alias("df")), "benchmark-terms")
    sizes = items.groupBy("class").agg(F.count(F.lit(1)), F.sum("n_words")).orderBy("class").collect()  # one row a doubling of the length
    total, words = sum(r[1] for r in sizes), sum(r[2] for r in sizes)
    now: list[Index] = []
    held = 0
    for klass, _, size in sizes:
        n = -(-size // shard_words)
        for k in range(n):
            own = items.where((F.col("class") == klass) & (F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k))
            rows = own.select("item_id", "text").collect()
            used = arrow_map(own.select("text"), terms, "term binary").distinct().join(df, "term").collect()
            if now and held + size // n > shard_words:
                yield now
                now, held = [], 0
            about = (total, words / total, {bytes(r[0]): r[1] for r in used})
            now.append(Index(sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])), about))
            held += size // n
    if now:
        yield now


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``doc_id, item_id, score, overlap, question_overlap, answer_overlap``: one row for each contaminated text and item."""
    small_batches(df.sparkSession)
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"
    names = [x.split()[0] for x in schema.split(", ")]
    out = None
    for indexes in passes(benchmark, shard_words=shard_words):
        held = df.sparkSession.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    words = words_of(t)
                    rows += [(d, *m) for index in held.value for m in index.matches(words)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k < 2 else pa.float64()) for k in range(6)], names=names)

        own = docs.mapInArrow(run, schema)
        out = own if out is None else out.unionByName(own)
    return df.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", *, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The rows of ``df`` that no item contaminates, with all their columns."""
    small_batches(df.sparkSession)
    at = df.columns.index(text_col)
    for indexes in passes(benchmark, shard_words=shard_words):
        held = df.sparkSession.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = map(words_of, batch.column(at).to_pylist())
                yield batch.filter(pa.array([not any(index.matches(w) for index in held.value) for w in words], pa.bool_()))

        df = df.mapInArrow(run, df.schema)
    return df
