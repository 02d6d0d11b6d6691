"""Periodic runs of words, from branching tandem repeats in a suffix tree.

A text's words are numbered.  A run of exponent ``EXPONENT`` holds each of its words that often, so rarer words can't be in
one: they cut the text into stretches, and what is left is one string with a mark of its own between stretches.

The string's suffix tree is its suffix array with the intervals of its longest common prefixes; each inner node has a depth D and
leaves.  A tandem repeat of period D whose next word breaks the period (a branching one) has its two halves under the
node of depth D, in different children.  So the leaves of all children but the largest are looked up both ways, ``i + D`` and ``i - D``,
which is O(n log n) leaves in all; the rank of a place says whether it lies under the node.  The same test at two more periods to the left
keeps the repeats that reach the exponent.  These are rotated to the left as long as words agree, which gives maximal
runs; repeats of one run (multiples of its period) merge into the smallest period.

Defined cases: a null or empty text and one of white space have no words and no run; very long texts are read whole, their leaves
in bounded lots; ties for the strongest run go to the smallest start, then the smallest period; repeated rows give equal rows; null ids
stay null, and count as the empty string where periods are planted; an empty table gives an empty result; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specaudit.llm.common import arrow_map, keyed_text

#: A run has this many periods at least, and this many words.
EXPONENT, LEAST = 4, 6
#: Leaves that are looked up at once.
LOT = 1 << 20

Run = tuple[int, int, int]


def suffix_order(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank of each suffix) by doubling the compared length."""
    n, k = len(s), 1
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    while True:
        key = rank * (n + 1)
        key[:-k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        now = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(now[1:] != now[:-1])])
        k *= 2
        if k >= n or rank[order[-1]] == n - 1:
            return order, rank


def common_prefixes(s: np.ndarray, order: np.ndarray, rank: np.ndarray) -> array:
    """How many words each suffix shares with the one before it in order."""
    word, before = array("q", s.tobytes()), array("q", np.concatenate([[-1], order[:-1]])[rank].tobytes())
    n, h, out = len(s), 0, array("q", bytes(8 * len(s)))
    place = array("q", rank.tobytes())
    for i in range(n):
        j = before[i]
        if j < 0:
            h = 0
            continue
        most = n - max(i, j)
        while h < most and word[i + h] == word[j + h]:
            h += 1
        out[place[i]] = h
        h -= h > 0
    return out


def smaller_children(lcp: array) -> Iterator[np.ndarray]:
    """Lots of rows (first leaf, last leaf, node's first, node's last, depth): leaves of each node but those of its largest child."""
    out, leaves, stack = array("q"), 0, []
    for k in range(1, len(lcp) + 1):
        d, low = lcp[k] if k < len(lcp) else 0, k - 1
        while stack and stack[-1][0] > d:
            depth, low, last, a, b = stack.pop()
            if k - last > b - a + 1:
                a, b = last, k - 1
            for x, y in ((low, a - 1), (b + 1, k - 1)):
                if x <= y:
                    out.extend((x, y, low, k - 1, depth))
                    leaves += y - x + 1
            if leaves >= LOT:
                yield np.array(out).reshape(-1, 5)
                out, leaves = array("q"), 0
        if not d:
            continue
        if stack and stack[-1][0] == d:
            node = stack[-1]
            if k - node[2] > node[4] - node[3] + 1:
                node[3:] = node[2], k - 1
            node[2] = k
        else:
            # depth, first leaf, where the last child begins, the largest child
            stack.append([d, low, k, low, k - 1])
    if out:
        yield np.array(out).reshape(-1, 5)


def branching_repeats(s: np.ndarray) -> np.ndarray:
    """Rows (period, end) of branching tandem repeats that go on to the left for ``EXPONENT`` periods."""
    n = len(s)
    order, rank = suffix_order(s)
    after = np.append(s, -1)
    found = []
    for lot in smaller_children(common_prefixes(s, order, rank)):
        # a lot of one node may hold more leaves than a lot: they are looked up piece by piece
        size = lot[:, 1] - lot[:, 0] + 1
        upto = np.cumsum(size)
        for at in range(0, int(upto[-1]), LOT):
            leaf = np.arange(at, min(at + LOT, upto[-1]))
            of = np.searchsorted(upto, leaf, side="right")
            i = order[lot[of, 0] + leaf - (upto[of] - size[of])]
            low, high, depth = lot[of, 2], lot[of, 3], lot[of, 4]
            for left in (i, i - depth):
                end = left + 2 * depth
                fit = (end - EXPONENT * depth >= 0) & (end <= n)
                for back in range(1, EXPONENT + 1):
                    r = rank[np.where(fit, end - back * depth, 0)]
                    fit &= (low <= r) & (r <= high)
                e, d = end[fit], depth[fit]
                open_ = after[e] != after[e - d]
                found.append(np.stack([d[open_], e[open_]], axis=1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def _start(s: np.ndarray, end: int, period: int) -> int:
    """Rotate a repeat of ``EXPONENT`` periods to the left as long as the period holds."""
    at, step = end - EXPONENT * period, 64
    while at > 0:
        low = max(0, at - step)
        (broken,) = np.nonzero(s[low:at] != s[low + period : at + period])
        if len(broken):
            return low + int(broken[-1]) + 1
        at, step = low, step * 2
    return at


def runs_of(ids: np.ndarray) -> list[Run]:
    """(start, length, period) of all maximal runs of a sequence of small whole numbers, by start, then period."""
    stay = np.bincount(ids)[ids] >= EXPONENT if len(ids) else np.zeros(0, bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], stay, [False]]).astype(np.int8)))
    pieces = [(a, b) for a, b in edges.reshape(-1, 2) if b - a >= LEAST]
    if not pieces:
        return []
    marks = int(ids.max()) + 1
    place = np.concatenate([np.arange(a, b + 1) for a, b in pieces])
    s = np.concatenate([np.append(ids[a:b], marks + k) for k, (a, b) in enumerate(pieces)])
    ends: dict[int, list[tuple[int, int]]] = {}
    for period, end in branching_repeats(s).tolist():
        known = ends.setdefault(end, [])
        # a period longer than a run's own, inside that run, is a multiple of it
        if not any(start <= end - 2 * period for start, _ in known):
            known.append((_start(s, end, period), period))
    return sorted((int(place[start]), end - start, period) for end, known in ends.items() for start, period in known if end - start >= LEAST)


def strongest(runs: list[Run]) -> Run | None:
    """The run of the greatest length over period, compared as whole numbers."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def plant(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """One text in ten by its id's checksum turns periodic from some word on, as the query's contract asks."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * ((n - a) // p + 1))[: n - a]


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without what repeats a run's first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    gone = np.cumsum(gone)
    return [w for w, g in zip(words, gone.tolist(), strict=False) if not g]


RUN = "struct<start: long, length: long, period: long>"


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, planted: bool = False) -> DataFrame:
    """``doc_id, runs, strongest, collapsed``: all runs of each text, the strongest, and the text's words with runs collapsed."""
    kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, best, texts = [], [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            words = text.as_py().split()  # bytes split at ASCII white space alone
            words = plant(words, doc_id) if planted else words
            number: dict[bytes, int] = {}
            runs = runs_of(np.array([number.setdefault(w, len(number)) for w in words], np.int64))
            rows = [dict(zip(("start", "length", "period"), r, strict=True)) for r in (*runs, *filter(None, [strongest(runs)]))]
            found.append(rows[: len(runs)])
            best.append(rows[-1] if rows else None)
            texts.append(b" ".join(collapse(words, runs)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(kind)), pa.array(best, kind), pa.array(texts, pa.binary())], names=["doc_id", "runs", "strongest", "collapsed"])

    out = arrow_map(keyed_text(df, id_col, text_col), find, f"doc_id long, runs array<{RUN}>, strongest {RUN}, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def run_digest(found: DataFrame) -> DataFrame:
    """Counts, the strongest run and digests of a table of :func:`periodic_runs`."""
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r.start, r.length, r.period)), "")
    best = [F.col(f"strongest.{c}").alias(c) for c in ("start", "length", "period")]
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
