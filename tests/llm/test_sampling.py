"""Resampling, mixing and periodic runs against brute force, on odd rows and on random ones."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from specaudit.llm import mixing, periodic, resampling
from specaudit.llm.mixing import block_texts, mixed, mixture
from specaudit.llm.periodic import periodic_runs, run_digest, runs_of
from specaudit.llm.ranking import ordered, with_rank
from specaudit.llm.resampling import features, resample

#: Every operator's own column names, so that they clash.
SCHEMA = "doc_id long, text string, source string, size long, skey string, slot long, sid int, rank int, score double, runs string, place int, `range` int, weight int"
REST = (9, "s1", 1, 2, 3, 4.0, "r", 5, 6, 7)
WORDS = ["the", "The", "a", "b", "É", "ß3", "日本", "x9", "don't", "e-mail", "\x85nel", "\xa0", "zz", "1", "\x1c", "q\tr"]


def odd_rows():
    rng = random.Random(3)
    rows = [(1, "", "b"), (2, None, "b"), (3, " \n\t ", None), (None, "a b a b a b a b a b", None), (None, None, "c"), (7, "one", "c"), (7, "one", "c"), (8, "x " * 3000, "d"), (9, "A-B 9z ÀÉ", "é")]
    rows += [(k, rng.choice([" ", "\n", ""]).join(rng.choice([x, x + " "]) for x in rng.choices(WORDS, k=rng.randrange(1, 90))), rng.choice(["a", "b", "c", "日", "Z", None])) for k in range(10, 90)]
    rows += [(k, "word " * 40, "a") for k in range(90, 110)]
    return [(*r, *REST) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)


def plain_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def bucket(f, buckets):
    return zlib.crc32(f.encode()) % buckets


@pytest.mark.parametrize("block", [1, 2, 7, 1 << 20])
def test_features_are_those_of_plain_counting(block):
    texts = [r[1] for r in odd_rows()]
    column = pa.array(["skipped", *(t or "" for t in texts), "skipped too"])[1:-1]
    got = Counter()
    for row, b, n in features(column, 50, block):
        for r, x, k in zip(row.tolist(), b.tolist(), n.tolist(), strict=True):
            got[r, x] += k
    expect = Counter((r, bucket(f, 50)) for r, t in enumerate(texts) for f in plain_features(t)[1])
    assert got == expect
    assert list(features(pa.array([], pa.string()))) == []


def plain_resample(rows, target, percent, least, seed, buckets):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(bucket(f, buckets) for f in plain_features(text)[1])
    for text in target:
        t.update(bucket(f, buckets) for f in plain_features(text)[1])
    ss, tt = sum(s.values()), sum(t.values())
    out, fit = [], []
    for doc_id, text in rows:
        words, fs = plain_features(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in (bucket(f, buckets) for f in fs)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc_id, len(fs), weight, score))
        if len(words) >= least:
            fit.append(out[-1])
    fit.sort(key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = fit[: percent * len(fit) // 100]
    ranks = defaultdict(list)
    for k, r in enumerate(drawn):
        ranks[r].append(k + 1)
    return sorted(((*r, ranks[r].pop(0) if ranks[r] else None) for r in out), key=str)


@pytest.mark.parametrize("percent,least,buckets", [(25, 20, 10_000), (100, 0, 7), (0, 1, 100), (40, 1, 3)])
def test_resampling(spark, odd, percent, least, buckets):
    target = ["the É 日本", None, "x9 x9 the"]
    got = resample(odd, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, least_words=least, buckets=buckets)
    expect = plain_resample([r[:2] for r in odd_rows()], target, percent, least, 7, buckets)
    # rows that share id and score may swap ranks
    assert sorted(map(tuple, got.collect()), key=str) == expect


def test_resampling_without_rows(spark, odd):
    none = spark.createDataFrame([], SCHEMA)
    assert resample(none, odd).count() == 0
    assert {r["weight"] for r in resample(odd, none, buckets=1).collect()} == {0}


def plain_targets(sizes, share, most, weights):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    want, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        rest = want - sum(most * sizes[s] for s in capped)
        target = {s: most * sizes[s] if s in capped else rest * w[s] / sum(w[x] for x in free) for s in order}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("block,weights", [(1, (5, 2, 1)), (16, (5, 2, 1)), (1024, (1, 9)), (64, (1,))])
def test_mixing(odd, block, weights):
    rows = [(r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")), r[2]) for r in odd_rows()]
    sizes = Counter()
    for _, n, s in rows:
        sizes[s] += n
    target = plain_targets(sizes, 1.5, 2, weights)
    got = mixed(odd, block=block, weights=weights).collect()
    assert sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in got), key=str) == sorted(((i, n, sizes[s], round(float(target[s]), 6)) for i, n, s in rows), key=str)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    taken = Counter()
    for r in got:
        taken[r["target"]] += r["taken"]
    for t in taken:
        same = [s for s in target if abs(target[s] - t) < 1e-6]
        assert abs(taken[t] - t * len(same)) <= len(same)
    again = mixed(odd.repartition(3), block=block, weights=weights).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_schedule_keeps_proportions_and_blocks_are_whole(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(f"{k}.{j}" for j in range(rng.randrange(1, 200))), f"s{rng.choice([0, 0, 0, 1, 2, 3])}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    documents, pieces = mixture(df, block=32)
    got = pieces.join(documents.select("rid", "source_size", "target"), "rid").toPandas().sort_values(["slot", "at"])
    full = got.groupby("slot").words.sum()
    assert (full <= 32).all() and (full < 32).sum() <= 4 and full.sum() == pytest.approx(documents.select("source_size", "target").distinct().toPandas().target.sum(), abs=4)
    share = documents.select("source_size", "target").distinct().toPandas().set_index("source_size").target
    share = share / share.sum()
    owner = got.groupby("slot").source_size.first()
    for upto in (50, 200, len(owner) // 2, len(owner)):
        part = owner.iloc[:upto].value_counts()
        for size, x in share.items():
            assert abs(part.get(size, 0) - x * upto) <= 2 + math.log2(upto)
    text = {r["slot"]: r["text"] for r in block_texts(df, pieces).collect()}
    by_id = {i: t.split() for i, t, _ in rows}
    for slot, own in got.groupby("slot"):
        assert text[slot] == " ".join(w for r in own.itertuples() for w in by_id[r.doc_id][r.first : r.first + r.words])


def test_mixing_in_many_cells(spark, odd, monkeypatch):
    monkeypatch.setattr(mixing, "STRETCH", 8)
    got = mixing.schedule(spark, spark.createDataFrame([(0, 1000), (1, 0), (2, 3), (3, 500), (4, 1)], "sid long, quota long"), 4).collect()
    per = defaultdict(list)
    for r in got:
        per[r["sid"]].append(r["rank"])
    assert {s: sorted(v) for s, v in per.items()} == {0: list(range(250)), 2: [0], 3: list(range(125)), 4: [0]}
    assert len({r["slot"] for r in got}) == len(got)


def test_mixing_without_rows(spark):
    assert mixed(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in mixed(spark.createDataFrame([(1, None, None, *REST)], SCHEMA)).collect()] == [(1, 0, 0, 0.0, 0)]


def test_places_in_order(spark):
    df = spark.range(1000).selectExpr("id", "id * 37 % 11 as k").repartition(7)
    got = with_rank(ordered(df, df.k.desc(), df.id, label="test-order"), "place").collect()
    assert [r["place"] for r in sorted(got, key=lambda r: (-r["k"], r["id"]))] == list(range(1000))


def plain_runs(s):
    n, out = len(s), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            a = i
            while i < n - q and s[i] == s[i + q]:
                i += 1
            length = i - a + q
            if i > a and length >= max(6, 4 * q) and not any(all(s[x] == s[x + p] for x in range(a, a + length - p)) for p in range(1, q)):
                out.append((a, length, q))
            i += i == a
    return sorted(out)


def random_words(rng):
    k, s = rng.choice([1, 2, 2, 3, 5]), []
    for _ in range(rng.randrange(5)):
        s += [rng.randrange(k) for _ in range(rng.randrange(12))]
        u = [rng.randrange(k) for _ in range(rng.randrange(1, 6))]
        s += (u * 9)[: len(u) * rng.randrange(2, 8) + rng.randrange(3)]
    return s


@pytest.mark.parametrize("lot", [3, 1 << 20])
def test_runs_are_all_maximal_runs(lot, monkeypatch):
    monkeypatch.setattr(periodic, "LOT", lot)
    rng = random.Random(lot)
    for _ in range(800):
        s = random_words(rng)
        assert runs_of(np.array(s, np.int64)) == plain_runs(s), s
    assert runs_of(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]
    assert runs_of(np.arange(30_000) % 7_000) == [(0, 30_000, 7_000)]


def plain_digest(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w)
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    milli = 1000 * best[1] // best[2] if runs else None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, milli, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_runs_of_texts(spark):
    rng = random.Random(9)
    rows = [r[:2] for r in odd_rows() if len(r[1] or "") < 5000] + [(k, rng.choice([" ", "\n\t", " \x0b"]).join("w\xa0xé"[x : x + 1] + "z" for x in random_words(rng))) for k in range(200, 500)]
    df = spark.createDataFrame([(*r, "s", *REST) for r in rows], SCHEMA)
    got = run_digest(periodic_runs(df, planted=True)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((plain_digest(*r) for r in rows), key=str)
    assert periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_collapsed_text(spark):
    df = spark.createDataFrame([(1, "so a b a b a b a b a end"), (2, "x x x x x"), (3, "x x x x x x")], "doc_id long, text string")
    got = {r["doc_id"]: (r["collapsed"], [tuple(x) for x in r["runs"]]) for r in periodic_runs(df).collect()}
    assert got == {1: ("so a b end", [(1, 9, 2)]), 2: ("x x x x x", []), 3: ("x", [(0, 6, 1)])}
