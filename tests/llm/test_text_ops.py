"""Token files, packing, exact dedup and SimHash against brute force, on odd rows and on random ones."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash

from specaudit.llm import common
from specaudit.llm import token_file as tf
from specaudit.llm.common import shared_dir
from specaudit.llm.exact_dedup import Polynomial, exact_dedup
from specaudit.llm.packing import BestFit, pack
from specaudit.llm.pieces import PieceEncoder
from specaudit.llm.simhash import NEAR, join_blocks, majority, near_duplicate_survivors, shingle_hashes, simhash_query, trie_links

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " ", "a", "a b", " a", "a  b", "a\n\n b", " x   y", "It's 2nd <|endoftext|> day's", "É́ ß ΣΑΣ", "x\t y \r\n z ", "word " * 500, " a b　 c", "don't 'S", "日本 語 text", "\x00 \x01", "a " + "z" * 9000]
SCHEMA = "doc_id long, text string, rid string, f1 int, `row` int, s0 string, task int"


def odd_rows():
    rows = [(k, t) for k, t in enumerate(ODD)]
    rows += [(3, "a"), (None, "a b"), (None, None), (100, "A  b"), (101, "ab"), (102, " a\tb")]
    return [(i, t, "r", 1, 2, "s", 3) for i, t in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def plain(path, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("path,prefix", [(BYTE, True), (WORD, False)])
def test_pieces_give_the_ids_of_whole_texts(path, prefix):
    rng = random.Random(5)
    bits = ["a", "The", "'s", "'", " ", " ", "  ", "\n", "\t", "É", "\u0301", "12", "3", ".", "!!", "\xa0", "ß", "Σ", "<|endoftext|>", "日", "x" * 40, "</w>", "İ", "-", "H\u0331", "H", "\u0338", "=", "<|", "endoftext", "|>", "\u3000", "\x85", "\x1c", "\r", "½", "’", "\x00", "\u200b", "\U0001f600", "'LL", "S", "<|ENDOFTEXT|>", "<|StartOfText|>"]
    texts = [t or "" for t in ODD] + ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(6000)]
    # a memo of few pieces turns over many times
    got = PieceEncoder(path, blank_prefix=prefix, limit=500)
    for k in range(0, len(texts), 100):
        for text, a, b in zip(texts[k : k + 100], got.encode(texts[k : k + 100]), plain(path, texts[k : k + 100]), strict=True):
            assert np.frombuffer(a, "<u4").tolist() == b, text


@pytest.mark.parametrize("n,kinds", [(0, 5), (1, 1), (5, 1), (70_000, 300), (200_001, 50_000)])
def test_rans_round_trip_and_checkpoints(n, kinds):
    rng = np.random.default_rng(n)
    tokens = np.minimum(rng.zipf(1.3, n), kinds).astype(np.int64) - 1
    symbols, counts = np.unique(tokens, return_counts=True) if n else (np.array([0]), np.array([1]))
    table = tf.Table.from_bytes(tf.Table.of_counts(symbols, counts).to_bytes())
    data = b"".join(tf.encode_blocks(tokens, table))
    blocks, at = [], 0
    while at < len(data):
        blocks.append(tf.Block(memoryview(data), at, tf.LANES))
        at = blocks[-1].end
    got = tf.decode_blocks(blocks, table)
    assert np.array_equal(np.concatenate(got) if got else np.zeros(0), tokens)
    full = [b for b in blocks if tf.CHECKPOINT_STEPS in b.marks]
    for b, part in zip(full, tf.decode_blocks(full, table, start=tf.CHECKPOINT_STEPS), strict=True):
        whole = got[blocks.index(b)]
        assert np.array_equal(part, whole[tf.CHECKPOINT_STEPS * tf.LANES :])


def test_rans_finds_damage_and_unknown_tokens():
    table = tf.Table.of_counts([0, 1, 2], [5, 3, 9])
    data = bytearray(tf.encode_frame([1], [1500], np.array([0, 1, 2] * 500), table))
    assert list(tf.decode_frame(bytes(data), table))[0][1] == 1500
    data[-1] ^= 255
    with pytest.raises(ValueError):
        list(tf.decode_frame(bytes(data), table))
    with pytest.raises(ValueError):
        tf.encode_blocks(np.array([7]), table)


def test_token_file_digest(spark, odd):
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in tf.token_file_digest(odd, BYTE).collect())
    rows = [(r[0], r[1]) for r in odd_rows()]
    ids = {k: x + [2] for k, x in enumerate(plain(BYTE, [t for _, t in rows]))}
    assert len(got) == len(rows)
    assert [g[2] for g in sorted(got, key=lambda g: g[2])] == list(np.cumsum([0] + [g[3] for g in sorted(got, key=lambda g: g[2])])[:-1])
    expect = sorted((d is not None, d or 0, len(ids[k]), zlib.crc32(np.array(ids[k], "<u4").tobytes())) for k, (d, _) in enumerate(rows))
    assert sorted((g[0], g[1], g[3], g[4]) for g in got) == expect
    in_order = [(g[0], g[1]) for g in sorted(got, key=lambda g: g[2])]
    assert in_order == sorted(in_order)
    assert tf.token_file_digest(odd.limit(0), BYTE).count() == 0


def test_packing(spark, odd):
    many = odd.select("doc_id", "text").union(spark.range(1000, 1300).selectExpr("id", "repeat('word and ', cast(pmod(id * 37, 1500) as int))"))
    rows = [(r.doc_id, r.text) for r in many.collect()]
    ids = [x + [0] for x in plain(WORD, [t for _, t in rows])]
    expect = sorted((d is None, d or 0, p, p * 2048, len(x[p * 2048 : p * 2048 + 2048]), zlib.crc32(np.array(x[p * 2048 : p * 2048 + 2048], "<u4").tobytes())) for (d, _), x in zip(rows, ids, strict=True) for p in range(-(-len(x) // 2048)))
    for bins in (512, 2):
        got = pack(many.repartition(5), WORD, open_bins=bins, fan_in=2).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expect
        by = {}
        for r in got:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for own in by.values():
            own.sort()
            assert [o for o, _ in own] == list(np.cumsum([0] + [n for _, n in own])[:-1]) and sum(own[-1]) <= 2048
        total = sum(map(len, ids))
        assert len(by) <= (1.06 if bins == 512 else 1.25) * -(-total // 2048) + 1
    assert pack(odd.limit(0), WORD).count() == 0


def test_best_fit_closes_the_fullest():
    fit = BestFit(10, 2)
    assert fit.put(7) == (0, 0) and fit.put(6) == (1, 0)
    assert fit.put(4) == (1, 6)  # the only one it fits
    assert fit.put(8) == (2, 0) and fit.put(9) == (3, 0)  # bin 2 holds more than bin 0 and closes
    assert dict(fit.left_open()) == {0: 7, 3: 9}


def test_polynomial_composes():
    poly = Polynomial(chunk=7)
    data = bytes(range(256)) * 3
    for cut in (0, 1, 7, 100, len(data)):
        assert poly.join(poly.of(data[:cut]), poly.of(data[cut:]), len(data) - cut) == poly.of(data)
    assert poly.of(data) == Polynomial().of(data)


def dedup_truth(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d is None, d or 0, d))
    return sorted(((d is None, d or 0), min(groups[key])[3], len(groups[key]), hashlib.sha256(key.encode()).hexdigest()) for d, t in rows for key in [re.sub(r"[\x20\x09-\x0D]", "", t or "")])


@pytest.mark.parametrize("how", [{}, {"chunk": 64}, {"moduli": ((2, 1),)}, {"moduli": ((3, 2),), "chunk": 16}])
def test_exact_dedup(spark, odd, how):
    rows = [(r[0], r[1]) for r in odd_rows()] + [(500 + k, "same text") for k in range(200)] + [(900 + k, "q" * 300 + str(k % 3)) for k in range(9)] + [(950 + k, "é long text " * 20_000 + " " * k) for k in range(3)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, f1 string")
    got = exact_dedup(df, **how).collect()
    assert sorted((((r.doc_id is None, r.doc_id or 0), r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == sorted(dedup_truth(rows), key=str)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup(df.limit(0), **how).count() == 0


def brute_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("n", [1, 2, 2048, 2049, 5000])
def test_majority_of_many_and_few(n):
    h = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    assert majority(h) == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h) > n)


def brute_components(ids, prints, budget):
    label = list(range(len(ids)))

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for a, b in itertools.combinations(range(len(ids)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= budget:
            label[find(a)] = find(b)
    least = {}
    for k, d in enumerate(ids):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return [least.get(find(k)) for k in range(len(ids))]


def test_simhash_of_odd_rows(spark, odd):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(300)) for _ in range(4)]
    near = [(1000 + k, base[k % 4].replace("aa", "AA", k) + " tail" * (k % 3)) for k in range(60)]
    rows = [(r[0], r[1]) for r in odd_rows()] + near + [(5000, " ".join(f"w{k % 977}" for k in range(20_000)))]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, s0 string, rep int")
    prints = [brute_fingerprint(t) for _, t in rows]
    expect = sorted(zip([d for d, _ in rows], [f"{p:016x}" for p in prints], brute_components([d for d, _ in rows], prints, 2), strict=True), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash_query(df).collect()), key=str) == expect
    assert simhash_query(df.limit(0)).count() == 0


@pytest.mark.parametrize("bits,budget,block", [(64, 2, 1 << 14), (64, 2, 16), (32, 3, 8), (64, 0, 4)])
def test_trie_join_against_all_pairs(spark, bits, budget, block):
    rng = random.Random(bits + budget)
    values = set()
    for _ in range(60):  # crowds round some centres, and strangers
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 12])):
            x = centre
            for _ in range(rng.randrange(0, 4)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    for _ in range(60):  # one path for all
        values.add(rng.getrandbits(10))
    values = sorted(values)
    df = spark.createDataFrame([(k, x - (1 << 64) if x >> 63 else x) for k, x in enumerate(values)], "rep long, s0 long")
    tables = [(0, 0, 64)] if bits == 64 else [(0, 0, 32), (0, 32, 32)]
    total = budget if bits == 64 else 5
    found = trie_links(df, tables, budget, total, block, 4 * block).collect()
    label = list(range(len(values)))

    def components(pairs):
        label = list(range(len(values)))
        for a, b in pairs:
            la, lb = label[a], label[b]
            label = [min(la, lb) if x in (la, lb) else x for x in label]
        return label

    def linked(a, b):
        d = values[a] ^ values[b]
        return d.bit_count() <= total and any((d >> low & ((1 << w) - 1)).bit_count() <= budget for _, low, w in tables)

    assert all((values[r.a] ^ values[r.b]).bit_count() <= 64 for r in found)
    assert components([(r.a, r.b) for r in found]) == components([(a, b) for a, b in itertools.combinations(range(len(values)), 2) if linked(a, b)])


def test_crowded_ranges_keep_every_link():
    rng = np.random.default_rng(1)
    sig = rng.integers(0, 1 << 12, (1500, 1)).astype(np.uint64)
    i, j = join_blocks(np.zeros(1500, np.uint64), sig, None, None, 1, 0, 1)
    label = np.arange(1500)
    label[i] = j
    assert (np.bitwise_count(sig[i, 0] ^ sig[j, 0]) >= 0).all()
    far = np.bitwise_count(sig[:, None, 0] ^ sig[None, :, 0])
    a, b = np.nonzero(far <= 1)
    assert (label[a] == label[b]).all()


def test_near_duplicate_survivors(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    rows = []
    for k in range(12):
        text = [word() for _ in range(400)]
        rows.append((10 * k, " ".join(text)))
        for c in range(3):
            text2 = list(text)
            text2[rng.randrange(400)] = word()
            rows.append((10 * k + 1 + c, " ".join(text2)))
    rows += [(5, "repeat"), (5, "repeat"), (None, "lonely null id"), (700, "other words stay here")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, digest string, gone_id string")
    got = sorted((r.doc_id for r in near_duplicate_survivors(df).collect()), key=str)
    assert got == sorted([10 * k for k in range(12)] + [5, None, 700], key=str)
    assert near_duplicate_survivors(df).columns == df.columns
    assert NEAR["words"] == 5 and len(shingle_hashes("a b c", 5, 42)) == 1


def test_near_duplicates_are_those_of_exact_similarity(spark):
    """Pairs from 0.7 to 0.9 and crowds round one text, against brute force."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    texts = []
    for k in range(240):
        n = rng.choice([12, 40, 150, 400])
        text = [word() for _ in range(n)]
        tail = round((n - 4) * rng.uniform(0.1, 0.3) / 1.6)  # of the same length, similarity about 0.69 to 0.88
        texts += [text, text[: n - tail] + [word() for _ in range(tail)]]
    for _ in range(3):
        text = [word() for _ in range(200)]
        texts += [[word() for _ in range(c)] + text[c:] for c in (rng.randrange(1, 60) for _ in range(30))]
    rows = list(enumerate(" ".join(t) for t in texts))
    sets = [{tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))} for t in texts]
    label, near, far = list(range(len(rows))), 0, 0
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if not both:
            continue
        share = both / (len(sets[a]) + len(sets[b]) - both)
        near, far = near + (0.8 <= share < 0.83), far + (0.75 <= share < 0.8)
        if share >= 0.8:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    assert near > 20 and far > 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_duplicate_survivors(df).collect()) == sorted(set(label))


def test_registered_queries_encode_added_tokens_as_the_library_does(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from specaudit.llm.queries import op1_token_file, op10_packing

    texts = ["a <|endoftext|> b", "<|startoftext|>x", "plain words", "<|end of", "A <|ENDOFTEXT|> b", "end<|endoftext|>\n\nnew  words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for path, end, run in ((BYTE, 2, op1_token_file), (WORD, 0, op10_packing), (WORD, 0, lambda s, d: corpus_pipeline.packed(s, df, d))):
        library = Tokenizer.from_file(path)
        expect = {k: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, end], "<u4").tobytes()) for k, t in enumerate(texts)}
        assert {r.doc_id: r.ids_crc32 for r in run(spark, str(tmp_path)).collect()} == expect


class FarSession:
    """A session on a cluster."""

    def __init__(self, **conf):
        self.conf, self.sparkContext = conf, type("Context", (), {"master": "spark://far:7077"})


def test_clusters_must_name_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(FarSession())
    assert shared_dir(FarSession(**{"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"


def test_sweep_deletes_what_was_written_since(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    first = common.materialize(spark.range(3), "a")
    since = common.mark()
    second, third = common.materialize(spark.range(3), "b"), common.materialize(spark.range(4), "c")
    common.sweep(since, third)
    assert first.count() == 3 and third.count() == 4 and sorted(p.name[0] for p in tmp_path.iterdir()) == ["a", "c"]
    assert second is not third and common.mark() == since + 1


def test_batches_of_long_texts_are_bounded_by_bytes(spark):
    from pyspark.sql import functions as F

    from specaudit.llm.common import BATCH_BYTES, arrow_map, keyed_text

    docs = keyed_text(spark.range(0, 200, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), 100_000).alias("text")), "doc_id", "text")
    sizes = arrow_map(docs, lambda b: pa.RecordBatch.from_pydict({"rows": [b.num_rows], "size": [b.nbytes]}), "rows long, size long").collect()
    assert sum(r["rows"] for r in sizes) == 200
    assert max(r["size"] for r in sizes) < BATCH_BYTES + (1 << 20)
