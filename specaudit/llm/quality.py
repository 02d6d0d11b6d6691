"""Quality classifier by weak labels.

Overlapping heuristics vote junk (-1), good (+1) or abstain (0) on every document.  Expectation
maximisation over the counts of vote patterns (all documents; at most 3**10 patterns) estimates each
heuristic's vote distribution for good and for junk texts and the share of good texts.  The posteriors
label a sample of ``SAMPLE`` documents, those of the least hashes, on which a linear scorer over hashed byte
pairs and shape features is trained; it scores every document.

Defined cases: null and blank texts score 0 and are rejected; if no document has a visible
character nothing is trained and all are rejected; a null id is kept; repeated rows vote each;
an empty table gives an empty result; other columns pass through :func:`keep_good`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specaudit.llm.common import small_batches

#: Training documents at most.
SAMPLE = 3000
PLACES = 1 << 11
#: A document below this score is rejected.
CUT = 0.3
#: Frequent function words of the common languages of the web.
COMMON = frozenset("the of and to in is that for it as was with on by de la le et les des un une en que el los las del y der die und das von mit zu ist den".split())
LONGEST, MARKS = max(map(len, COMMON)), ".,!?"
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#$%&*@^~=+<>{}[]|\\`_")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LOWER = np.zeros(256, bool)
LOWER[97:123] = True
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
VOTERS = ("symbols", "upper", "shouting", "top word", "repeats", "word length", "line ends", "columns", "function words", "stutter")


def shape(text: str, byte_counts: np.ndarray) -> dict[str, float]:
    words = text.split()
    n = len(words)
    visible = max(1, int(byte_counts[~SPACE].sum()))
    letters = max(1, int(byte_counts[UPPER | LOWER].sum()))
    tally = Counter(words)
    lines = [x for x in map(str.strip, text.split("\n")) if x.count(" ") >= 3]
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    stutter = float((h[1:] == h[:-1]).mean()) if n >= 10 else math.nan
    if n >= 30:
        # windows of eight words, as a rolling mix
        w = np.zeros(n - 7, np.uint64)
        for k in range(8):
            w = w * np.uint64(6364136223846793005) + h[k : n - 7 + k]
        fresh = len(np.unique(w)) / len(w)
    else:
        fresh = math.nan
    return {
        "n": n,
        "symbols": int(byte_counts[SYMBOLS].sum()) / visible,
        "upper": int(byte_counts[UPPER].sum()) / letters,
        "shouting": int(byte_counts[33] + byte_counts[63]) / max(1, n),
        "top": tally.most_common(1)[0][1] / n if n else 0.0,
        "fresh": fresh,
        "stutter": stutter,
        "length": len(text) / max(1, n) - 1,
        "ends": sum(bool(re.search(r"[.!?:;\"»”]$", x)) for x in lines) / len(lines) if lines else math.nan,
        "columns": int(byte_counts[124] + byte_counts[9]) / max(1, n),
        # a longer word without a mark at its ends is none of them
        "common": sum(c for w, c in tally.items() if (len(w) <= LONGEST or w[0] in MARKS or w[-1] in MARKS) and w.lower().strip(MARKS) in COMMON) / max(1, n),
    }


def votes(s: dict[str, float]) -> tuple[int, ...]:
    def of(x: float, junk: bool, good: bool) -> int:
        return 0 if math.isnan(x) else -1 if junk else 1 if good else 0

    long = s["n"] >= 20
    return (
        of(s["symbols"], s["symbols"] > 0.05, s["symbols"] < 0.01),
        of(s["upper"], s["upper"] > 0.5, s["upper"] < 0.2),
        of(s["shouting"], s["shouting"] > 0.2, s["shouting"] < 0.05),
        of(s["top"], long and s["top"] > 0.25, long and s["top"] < 0.15),
        of(s["fresh"], s["fresh"] < 0.5, s["fresh"] > 0.9),
        of(s["length"], s["length"] > 14 or s["length"] < 1.5, 2.5 < s["length"] < 9),
        of(s["ends"], s["ends"] < 0.2, s["ends"] > 0.7),
        of(s["columns"], s["columns"] > 0.15, s["columns"] < 0.02),
        of(s["common"], long and s["common"] < 0.02, long and s["common"] > 0.1),
        of(s["stutter"], s["stutter"] > 0.3, s["stutter"] < 0.05),
    )


def features(text: str) -> tuple[tuple[int, ...], np.ndarray]:
    """Votes, and the scorer's vector: square roots of hashed byte-pair shares, then shape features."""
    data = text.encode("utf-8", "surrogatepass")
    bytes_ = np.zeros(256, np.int64)
    pairs = np.zeros(PLACES, np.int64)
    for at in range(0, len(data), 1 << 20):
        b = np.frombuffer(data[max(0, at - 1) : at + (1 << 20)], np.uint8)
        bytes_ += np.bincount(b[min(1, at) :], minlength=256)
        code = b[:-1].astype(np.uint32) * np.uint32(256) + b[1:]
        pairs += np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - PLACES.bit_length() + 1), minlength=PLACES)
    s = shape(text, bytes_)
    extra = [s["symbols"], s["upper"], min(1, s["shouting"]), s["top"], 1 - (1 if math.isnan(s["fresh"]) else s["fresh"]), min(3, s["length"] / 10), 0.5 if math.isnan(s["ends"]) else s["ends"], min(1, s["columns"]), s["common"], 0.0 if math.isnan(s["stutter"]) else s["stutter"], 1.0]
    return votes(s), np.concatenate([np.sqrt(pairs / max(1, pairs.sum())), extra]).astype(np.float32)


#: Kinds of junk, each anchored by the voters that name it.
KINDS = (("symbols",), ("upper", "shouting"), ("top word", "repeats", "stutter"), ("columns",))
#: What is believed beforehand of a vote (junk, none, good): of an anchor on its kind, of an anchor on good texts, and of any other voter
#: on any class; and how many documents of a kind that belief is worth.  The votes outweigh it as soon as a kind has a few dozen documents.
ANCHOR, SLIP, OTHER = (0.9, 0.01, 0.09), (0.005, 0.005, 0.99), (0.02, 0.01, 0.97)
BELIEF = 20.0
#: For good texts the belief is worth this share of all documents: a kind that one voter alone names is told from that voter's slips by nothing else.
GOOD_BELIEF = 0.2


def label_model(patterns: dict[tuple[int, ...], int], rounds: int = 300) -> tuple[dict[tuple[int, ...], float], np.ndarray, np.ndarray]:
    """Posterior of "good" for each pattern, the shares of good and of each kind of junk, and vote distributions [class, voter, vote].

    Junk has several kinds with little in common, so the latent class is "good" or one of the kinds; given
    the class, voters err independently.  Their accuracies (how often a voter says junk on each kind, and on good texts)
    are what EM estimates, from a Dirichlet prior that names the classes.
    """
    keys = list(patterns)
    n = np.array([patterns[k] for k in keys], float)
    hot = np.eye(3)[np.array(keys) + 1]  # pattern, voter, vote
    hot[..., 1] = 0  # who abstains says nothing
    prior = np.empty((1 + len(KINDS), hot.shape[1], 3))
    prior[:] = OTHER
    for y, kind in enumerate(KINDS, 1):
        own = [VOTERS.index(x) for x in kind]
        prior[y, own], prior[0, own] = ANCHOR, SLIP
    weight = np.full(len(prior), BELIEF)
    weight[0] += GOOD_BELIEF * n.sum()
    p, post = prior, None
    share = np.full(len(p), 0.2 / len(KINDS))
    share[0] = 0.8
    for _ in range(rounds):
        log = np.log(share)[:, None] + np.einsum("pvk,yvk->yp", hot, np.log(p))
        new = np.exp(log - log.max(axis=0))
        new /= new.sum(axis=0)
        if post is not None and np.abs(new - post).max() < 1e-9:
            break
        post = new
        share = (post @ n + 1) / (n.sum() + len(p))
        own = np.einsum("p,yp,pvk->yvk", n, post, hot) + weight[:, None, None] * prior
        p = own / own.sum(axis=2, keepdims=True)
    return dict(zip(keys, post[0].tolist(), strict=True)), share, p


def train_linear(x: np.ndarray, y: np.ndarray, rounds: int = 300, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels by Adam, whole sample a step; each class weighs the same."""
    share = float(np.clip(y.mean(), 0.02, 0.98))
    weight = (y / share + (1 - y) / (1 - share)) / 2
    weight /= weight.sum()
    w, m, s = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ ((p - y) * weight).astype(np.float32) + np.float32(decay) * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
    return w.astype(np.float32)


def fit(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    """Weights of the scorer from (doc_id, text); None if no text has a visible character."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text and not text.isspace():
                    tally[features(text)[0]] += 1
        yield pa.RecordBatch.from_pydict({"votes": pa.array([list(k) for k in tally], pa.list_(pa.int32())), "n": pa.array(list(tally.values()), pa.int64())})

    patterns = {tuple(r[0]): r[1] for r in docs.select("text").mapInArrow(vote, "votes array<int>, n long").groupBy("votes").agg(F.sum("n")).collect()}
    if not patterns:
        return None
    post, _, _ = label_model(patterns)
    total = sum(patterns.values())
    # twice as many as are wanted by hash, of which the least hashes are taken: all of a table of no more than that
    h = F.xxhash64("doc_id", "text")
    chosen = docs.where((h / F.lit(2.0**64) + 0.5) <= min(1.0, 2 * sample / total)).orderBy(h).limit(sample)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [features(t) for t in batch.column("text").to_pylist() if t and not t.isspace()]
            yield pa.RecordBatch.from_pydict({"votes": pa.array([list(v) for v, _ in own], pa.list_(pa.int32())), "x": pa.array([x.tobytes() for _, x in own], pa.binary())})

    rows = chosen.select("text").mapInArrow(vectors, "votes array<int>, x binary").collect()
    if not rows:
        return None
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows])
    return train_linear(x, np.array([post[tuple(r["votes"])] for r in rows]))


def score(text: str | None, w: np.ndarray | None) -> float:
    if w is None or not text or text.isspace():
        return 0.0
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, float(features(text)[1] @ w)))))


def _docs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, cut: float = CUT, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, score, kept`` of every row."""
    docs = _docs(df, id_col, text_col)
    w = df.sparkSession.sparkContext.broadcast(fit(docs, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [score(t, w.value) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(s, pa.float64()), "kept": pa.array([x >= cut for x in s], pa.bool_())})

    return docs.mapInArrow(run, "doc_id long, score double, kept boolean")


def keep_good(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, cut: float = CUT, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``df`` that are not rejected, with all their columns."""
    w = df.sparkSession.sparkContext.broadcast(fit(_docs(df, id_col, text_col), sample))
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([score(t, w.value) >= cut for t in batch.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)
