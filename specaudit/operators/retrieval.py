"""Hybrid retrieval: BM25, dense and exhaustive ranks, fusion, priors, neighbours, dedup, caps, rerank.

All requests go through one plan, keyed by ``request_id``.  Tokens that no query asks for are dropped where a passage is read,
before anything is counted or moved; ranks are cut to the top k inside the window
(``WindowGroupLimit``) before lists are joined.  Ties end on ``corpus_idx``, so results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specaudit.functions import text

K1, B, TF_CAP = 1.5, 0.75, 2
RRF_K = 60


def postings(docs: DataFrame, wanted: DataFrame, id_col: str = "corpus_idx", text_col: str = "text") -> DataFrame:
    """``corpus_idx, token, tf, dl`` of the tokens in ``wanted`` (token); others go before they are counted, and counts are summed on each task first."""
    own = docs.select(F.col(id_col).alias("corpus_idx"), text.tokens(F.col(text_col)).alias("tokens"))
    rows = own.select("corpus_idx", F.size("tokens").alias("dl"), F.explode("tokens").alias("token"))
    return rows.join(wanted, "token", "left_semi").groupBy("corpus_idx", "dl", "token").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: ``n, avgdl`` (1 at least)."""
    return docs.select(F.size(text.tokens(F.col(text_col))).alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl"))


def query_tokens(queries: DataFrame) -> DataFrame:
    """(request_id, query_idx, query) to ``request_id, query_idx, token, qtf``; a token counts twice at most."""
    rows = queries.select("request_id", "query_idx", F.explode(text.tokens(F.col("query"))).alias("token"))
    return rows.groupBy("request_id", "query_idx", "token").agg(F.least(F.count(F.lit(1)), F.lit(TF_CAP)).alias("qtf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "corpus_idx", text_col: str = "text") -> DataFrame:
    """``request_id, query_idx, corpus_idx, score, rank``: the top ``k`` of each query with positive scores."""
    asked = query_tokens(queries)
    few = _small(asked, BROADCAST_TOKENS)
    send = F.broadcast if few else (lambda df: df)
    own = postings(docs, send(asked.select("token").distinct()), id_col, text_col)
    df = own.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    # one row a token of the queries, one row for the corpus; the statistics cover the whole corpus
    weights = asked.join(df, "token").crossJoin(F.broadcast(corpus_stats(docs, text_col)))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    impact = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    # a passage's postings stand together since they were counted, so its sum leaves the task as one row
    scored = own.join(send(weights), "token").groupBy("request_id", "query_idx", "corpus_idx").agg(F.round(F.sum(impact * F.col("qtf")), 9).alias("score"))
    return top(scored.where("score > 0"), ["request_id", "query_idx"], "score", k)


#: Requests, and tokens of requests (about 60 bytes each), that are sent to every task; more are joined by a shuffle.
BROADCAST_QUERIES, BROADCAST_TOKENS = 10_000, 200_000


def _small(rows: DataFrame, most: int = BROADCAST_QUERIES) -> bool:
    return rows.limit(most + 1).count() <= most


def top(scored: DataFrame, keys: list[str], score: str, k: int, id_col: str = "corpus_idx") -> DataFrame:
    """The ``k`` best rows of each key with their ``rank``."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(id_col))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Query vectors of one block: 2,000 of 768 doubles are 12 MB.
QUERY_BLOCK = 2000
HITS = "request_id string, query_idx int, corpus_idx long, score double"


def dense(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "corpus_idx") -> DataFrame:
    """Exact cosine top ``k`` of unit vectors.  queries: ``request_id, query_idx, query_vector``, taken in blocks against one scan.

    A block of ``QUERY_BLOCK`` query vectors is sent to all tasks as a matrix; a task multiplies its vectors with it batch by
    batch and hands on its own top k of each query, so pairs never exist as rows.  Vectors of another length than the queries' are left out,
    as are null ones; scores are rounded to nine places before they are compared, and ties go to the lesser id.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    own = vectors.select(F.col(id_col).cast("long").alias("corpus_idx"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    out = None
    for n in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("request_id", "query_idx"), F.lit(blocks)) == n).select("request_id", "query_idx", F.col("query_vector").cast("array<double>").alias("v")).where("v is not null").collect()
        by_length: dict[int, list] = {}
        for r in block:
            by_length.setdefault(len(r["v"]), []).append(r)
        for length, rows in by_length.items():
            names, matrix = [(r["request_id"], r["query_idx"]) for r in rows], np.array([r["v"] for r in rows], np.float64).T
            sent = vectors.sparkSession.sparkContext.broadcast((names, matrix))
            found = own.where(F.size("embedding") == length).mapInArrow(_nearest(sent, k), HITS)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], HITS)
    return top(out, ["request_id", "query_idx"], "score", k)


def keep_best(ids: np.ndarray, which: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (id, query, score) the ``k`` best of each query; ties go to the lesser id."""
    order = np.lexsort((ids, -score, which))
    ids, which, score = ids[order], which[order], score[order]
    rank = np.arange(len(which)) - np.searchsorted(which, which)
    return ids[rank < k], which[rank < k], score[rank < k]


def _nearest(sent, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's top ``k`` of each query, of the broadcast names and matrix of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = sent.value
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("corpus_idx").to_numpy(zero_copy_only=False)
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for at in range(0, len(names), 256):
                score = np.round(x @ matrix[:, at : at + 256], 9)
                # whatever ties with the k-th of this batch stays in the running
                least = np.partition(score, -k, axis=0)[-k] if len(score) > k else np.full(score.shape[1], -np.inf)
                row, query = np.nonzero(score >= least)
                held = tuple(np.concatenate(c) for c in zip(held, (ids[row], query + at, score[row, query]), strict=True))
            held = keep_best(*held, k)
        ids, which, score = held
        yield pa.RecordBatch.from_pydict({"request_id": pa.array([names[q][0] for q in which.tolist()], pa.string()), "query_idx": pa.array([names[q][1] for q in which.tolist()], pa.int32()), "corpus_idx": pa.array(ids, pa.int64()), "score": pa.array(score, pa.float64())})

    return run


def best_ranks(ranked: DataFrame, channel: str) -> DataFrame:
    """Best rank of each document over the queries of a request; of equal ranks the earliest query's."""
    best = F.min(F.struct("rank", "query_idx"))
    return ranked.groupBy("request_id", "corpus_idx").agg(best.alias("b")).select("request_id", "corpus_idx", F.col("b.rank").alias(f"{channel}_rank"), F.col("b.query_idx").alias(f"{channel}_query"))


#: Feature patterns that are looked for in one pass; the catalogue has eight, and more go in further passes.
MOST_FEATURES = 256


def scan(docs: DataFrame, requests: DataFrame, limit: int) -> DataFrame:
    """Exhaustive scan: feature word and value with unit, then overlap with phrases, standard and context.

    requests: ``request_id, feature, phrases, preferred, context_tokens`` (a row a request).  Each passage is tagged once with the
    features it names, and requests are joined on the feature.  Gives ``request_id, corpus_idx, score, rank``.
    """
    features = sorted(r[0] for r in requests.select("feature").distinct().collect())
    scored = None
    for at in range(0, max(1, len(features)), MOST_FEATURES):
        some = _scanned(docs, requests, features[at : at + MOST_FEATURES])
        scored = some if scored is None else scored.unionByName(some)
    return top(scored, ["request_id"], "score", limit)


def _scanned(docs: DataFrame, requests: DataFrame, features: list[str]) -> DataFrame:
    named = F.filter(F.array(*(F.when(F.col("text").rlike("(?i)" + f), F.lit(f)) for f in features), F.lit(None).cast("string")), lambda x: x.isNotNull())
    own = docs.where(text.has_value_with_unit(F.col("text"))).select("corpus_idx", "standard_id", "text", named.alias("features")).where("size(features) > 0")
    own = own.select("corpus_idx", "standard_id", F.array_distinct(text.tokens(F.col("text"))).alias("tokens"), F.explode("features").alias("feature"))
    asked = requests.select("request_id", "feature", "preferred", "context_tokens", F.transform("phrases", lambda p: F.array_distinct(text.tokens(p))).alias("wanted"))
    pairs = own.join(F.broadcast(asked) if _small(requests) else asked, "feature")
    overlap = F.array_max(F.transform("wanted", lambda w: F.size(F.array_intersect(w, "tokens")) / F.greatest(F.size(w), F.lit(1))))
    bonus = F.when(preferred_standard(F.col("standard_id"), F.col("preferred")), 0.35).otherwise(0.0)
    context = F.least(F.size(F.array_intersect("tokens", "context_tokens")) / F.greatest(F.size("context_tokens"), F.lit(1)), F.lit(0.25))
    return pairs.withColumn("overlap", overlap).where("overlap >= 0.34D").select("request_id", "corpus_idx", F.round(F.col("overlap") + bonus + context, 9).alias("score"))


def preferred_standard(standard_id: Column, preferred: Column) -> Column:
    return F.coalesce(F.exists(preferred, lambda p: F.upper(standard_id).startswith(F.upper(p))), F.lit(False))


def fuse(dense_ranks: DataFrame | None, lexical_ranks: DataFrame, scan_ranks: DataFrame | None = None) -> DataFrame:
    """Reciprocal-rank fusion; the weights depend on whether the request's scan found anything."""
    out = lexical_ranks
    out = out.join(dense_ranks, ["request_id", "corpus_idx"], "full") if dense_ranks is not None else out.withColumn("dense_rank", F.lit(None).cast("int")).withColumn("dense_query", F.lit(None).cast("int"))
    if scan_ranks is None:
        out = out.withColumn("scan_rank", F.lit(None).cast("int"))
    else:
        out = out.join(scan_ranks.select("request_id", "corpus_idx", F.col("rank").alias("scan_rank")), ["request_id", "corpus_idx"], "full")
    scanned = F.max(F.col("scan_rank").isNotNull()).over(Window.partitionBy("request_id"))

    def part(rank: str, with_scan: float, without: float) -> Column:
        return F.coalesce(F.when(scanned, F.lit(with_scan)).otherwise(F.lit(without)) / (RRF_K + F.col(rank)), F.lit(0.0))

    return out.withColumn("fusion", part("dense_rank", 0.46, 0.56) + part("lexical_rank", 0.34, 0.44) + part("scan_rank", 0.20, 0.0))


def priors(score: Column, *, preferred: Column, multiplier: Column, overlap: Column, exact: Column, unit: Column) -> Column:
    """Fused score with its priors, in this order: standard, context, overlap, phrase, unit, then the bonus for both."""
    score = score * F.when(preferred, 1.18).otherwise(1.0) * multiplier * (1.0 + F.least(overlap, F.lit(0.35)))
    score = score * F.when(exact, 1.28).otherwise(1.0) * F.when(unit, 1.12).otherwise(0.82)
    return score + F.when(exact & unit, 0.022).otherwise(0.0)


def neighbours(hits: DataFrame, chunks: DataFrame, *, hit_limit: int, window: int) -> DataFrame:
    """Chunks beside the best hits of each request, at 0.92 of their score and without ranks."""
    best = top(hits, ["request_id"], "score", hit_limit).where("chunk_index is not null")
    offsets = F.array(*(F.lit(o) for o in range(-window, window + 1) if o))
    wanted = best.select("request_id", "source_path", (F.col("score") * 0.92).alias("score"), F.col("chunk_index").alias("__at"), F.explode(offsets).alias("__by")).withColumn("chunk_index", F.col("__at") + F.col("__by")).drop("__at", "__by")
    return wanted.join(chunks, ["source_path", "chunk_index"])


def provenance_key(content_hash: Column, body: Column) -> Column:
    return F.coalesce(F.nullif(content_hash, F.lit("")), F.substring(F.lower(F.regexp_replace(body, r"\s+", " ")), 1, 500))


def dedup(hits: DataFrame, order: list[str] | None = None) -> DataFrame:
    """A hit stays if it is the first of its evidence id and the first of its provenance key, both over all hits.

    hits: ``request_id, evidence_id, provenance, score, corpus_idx, ..``.  Firsts are minima, so a hot key is merged on each task.
    """
    first = F.struct(*(order or [(-F.col("score")).alias("a"), F.col("corpus_idx").alias("b")]))
    hits = hits.withColumn("__o", first)
    by_id = hits.groupBy("request_id", "evidence_id").agg(F.min("__o").alias("__i"))
    by_key = hits.groupBy("request_id", "provenance").agg(F.min("__o").alias("__p"))
    return hits.join(by_id, ["request_id", "evidence_id"]).join(by_key, ["request_id", "provenance"]).where("__o = __i and __o = __p").dropDuplicates(["request_id", "evidence_id"]).drop("__o", "__i", "__p")


def diversify(hits: DataFrame, limit: int, *, per_source: int = 4, per_page: int = 2) -> DataFrame:
    """Two hits a page, then four a source, then the first ``limit`` of a request, by score."""
    order = [F.col("score").desc(), F.col("corpus_idx")]

    def capped(df: DataFrame, keys: list[str], n: int) -> DataFrame:
        return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")

    out = capped(capped(hits, ["request_id", "source", "page"], per_page), ["request_id", "source"], per_source)
    return out.withColumn("final_rank", F.row_number().over(Window.partitionBy("request_id").orderBy(*order))).where(F.col("final_rank") <= limit)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))


def rerank(hits: DataFrame, score_pairs: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Semantic score dominates, fusion breaks near-ties: 0.88 * sigmoid(best raw) + 0.12 * min-max of the fused score.

    hits: ``request_id, corpus_idx, text, score, queries`` (the hit's best queries, in order).  ``score_pairs`` gets distinct
    ``query, text`` and adds ``raw``; it runs once a pair.
    """
    pairs = hits.select("request_id", "corpus_idx", "text", F.posexplode("queries").alias("pos", "query"))
    raw = score_pairs(pairs.select("query", "text").distinct()).select("query", "text", "raw")
    best = pairs.join(raw, ["query", "text"]).groupBy("request_id", "corpus_idx").agg(F.max(F.struct("raw", (-F.col("pos")).alias("p"), "query")).alias("w"))
    request = Window.partitionBy("request_id")
    low, high = F.min("score").over(request), F.max("score").over(request)
    fused = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(0.5)
    out = hits.withColumn("fusion_norm", fused).join(best, ["request_id", "corpus_idx"])
    return out.withColumn("fusion_score", F.bround("score", 8)).withColumn("reranker_score", F.bround("w.raw", 8)).withColumn("reranker_winning_query", F.col("w.query")).withColumn("score", 0.88 * sigmoid(F.col("w.raw")) + 0.12 * F.col("fusion_norm")).drop("w", "fusion_norm")


def structured_scores(candidates: DataFrame) -> DataFrame:
    """Map verified records onto the fused range by their lexical relevance.

    candidates: ``request_id, corpus_idx, structured, relevance, score`` (score null for structured rows).
    """
    request = Window.partitionBy("request_id")
    low, high = F.min("relevance").over(request), F.max("relevance").over(request)
    fused_low = F.coalesce(F.min(F.when(~F.col("structured"), F.col("score"))).over(request), F.lit(0.0))
    fused_high = F.coalesce(F.max(F.when(~F.col("structured"), F.col("score"))).over(request), F.lit(1.0 / 61))
    prior = F.when(high > low, (F.col("relevance") - low) / (high - low)).otherwise(0.5)
    return candidates.withColumn("prior", prior).withColumn("score", F.when(F.col("structured"), fused_low + F.col("prior") * (fused_high - fused_low)).otherwise(F.col("score")))


def evidence_blocks(hits: DataFrame, max_chars: int = 18_000) -> DataFrame:
    """Evidence blocks of a request in rank order, cut where the budget is spent; the first always stays."""

    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("unknown"))

    header = F.concat(F.lit("["), F.col("evidence_id"), F.lit("] source="), F.col("source"), F.lit("; standard="), shown("standard_id"), F.lit("; edition="), shown("edition_year"), F.lit("; page="), shown("page"), F.lit("; section="), shown("section"))
    block = F.concat(header, F.lit("\n"), F.trim("text"))
    order = Window.partitionBy("request_id").orderBy("rank")
    out = hits.withColumn("block", block).withColumn("used", F.sum(F.length("block")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("__first", F.row_number().over(order) == 1).where(F.col("__first") | (F.col("used") <= max_chars)).drop("__first")


def dedup_two_rank(hits: DataFrame) -> DataFrame:
    """The same as :func:`dedup` by two windows; for requests of bounded size."""
    o = [F.col("score").desc(), F.col("corpus_idx")]
    ranked = hits.withColumn("__i", F.row_number().over(Window.partitionBy("request_id", "evidence_id").orderBy(*o))).withColumn("__p", F.row_number().over(Window.partitionBy("request_id", "provenance").orderBy(*o)))
    return ranked.where("__i = 1 and __p = 1").drop("__i", "__p")
