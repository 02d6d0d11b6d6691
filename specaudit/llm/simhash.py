"""SimHash near-duplicates by a binary trie joined with itself.

Fingerprints are leaves of a binary trie.  A pair of nodes of equal depth carries the number
of bits in which their paths differ; its children are the up to four pairs of their
children, and a pair whose bits exceed the Hamming budget is dropped with all below it.

Distribution.  Two keys that differ in at most ``budget`` bits agree in one of ``budget + 1`` segments, so each key stands in as many
tries, each with another segment turned to the top, and a trie is cut at that segment into subtrees ("blocks") that are joined with
themselves alone: a fingerprint travels ``budget + 1`` times, whatever their number.  A crowded block is cut
deeper, and then its parts are paired by the same rule over their paths; each pair of blocks is joined in one task over two sorted arrays.
A task returns a spanning forest of the links it finds, so a dense group never becomes all
its pairs; components then run over distinct fingerprints only.

Near-duplicates by similarity (:func:`near_duplicate_survivors`) take links of several tries and of min-wise bands as
proposals; texts of a proposed class are then compared as sets of shingles.  Texts travel compressed, and only those of proposed classes become sets.

Defined cases: a null text counts as empty; no words gives fingerprint zero, linked like any
other; fewer words than a shingle make one shingle; rows with a null id are linked like others
and never name a component that has another id; repeated rows share a component; an empty
table gives an empty result; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specaudit.llm.common import arrow_map, discard, keyed_text, materialize, total_cores
from specaudit.llm.components import connected_components

#: Fingerprints in a block on average, at least; a block of more than ``CROWD`` is cut deeper, down to where a path ends.
BLOCK, CROWD = 1 << 10, 1 << 15
#: Fingerprints that a task joins, about.
TASK = 1 << 17
#: Node pairs that are walked at once, and fingerprint pairs compared at once.
WALK = 1 << 15
#: Hashes whose bits are added up as they are; both ways give the same sums, and counts by value are faster for more.
FEW = 2048
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: Min-wise bands: at similarity 0.8 two sets share one of them with a chance of 1 - (1 - 0.8 ** 5) ** 20 = 0.9996.
BANDS, BAND_ROWS = 20, 5
_odd = np.random.default_rng(6).integers(0, 1 << 63, (2, BANDS * BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BAND_MIX, BAND_FOLD = _odd[0], _odd[1]
#: Sets of a class that all others are compared with first, and sets in a chunk of those that are then left.
LEADERS, CHUNK = 4, 64
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def shingle_hashes(text: str, words: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle of ``words`` words, A-Z lower-cased, repeats included."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], seed) for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)


def majority(h: np.ndarray) -> int:
    """The number whose bits are set in over half of ``h``: columns of bits are added up, or counts by byte value where there are many."""
    if not len(h):
        return 0
    columns = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    if len(h) <= FEW:
        ones = np.add.reduce(np.unpackbits(columns, axis=1, bitorder="little"), axis=0, dtype=np.uint16).astype(np.int64)
    else:
        ones = np.concatenate([np.bincount(columns[:, k], minlength=256) @ BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def remixed(h: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th further 64-bit hash of hashed shingles (0: themselves)."""
    if not k:
        return h
    z = h + np.uint64(k * int(MIX[0]) & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * MIX[1]
    z = (z ^ (z >> np.uint64(27))) * MIX[2]
    return z ^ (z >> np.uint64(31))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def band_keys(h: np.ndarray) -> np.ndarray:
    """A signed key of each band: sets of Jaccard similarity s share one with a chance of s ** BAND_ROWS."""
    if not len(h):
        return np.zeros(0, np.int64)
    least = np.full(len(BAND_MIX), np.uint64((1 << 64) - 1))
    for k in range(0, len(h), 4096):
        least = np.minimum(least, (h[k : k + 4096, None] * BAND_MIX).min(axis=0))
    folded = (remixed(least, 1) * BAND_FOLD).reshape(BANDS, BAND_ROWS).sum(axis=1, dtype=np.uint64)
    return remixed(folded + np.arange(BANDS, dtype=np.uint64), 2).view(np.int64)


def fingerprints(docs: DataFrame, words: int, seed: int, lengths: int = 1, sets: bool = False) -> DataFrame:
    """(doc_id, text, ...) to the same without text and with ``s0 ..``: 64 fingerprint bits each, as signed longs.

    sets: each shingle counts once, and ``same`` (a digest of the set), ``bands`` and ``packed`` (the text, compressed) are added.
    """
    keep = [c for c in docs.columns if c != "text"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, same, bands, packed = [[] for _ in range(lengths)], [], [], []
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for text in batch.column("text").to_pylist():
            h = shingle_hashes(text, words, seed)
            if sets:
                h = np.unique(h)
                same.append(xxhash.xxh3_128_digest(h.astype("<u8").tobytes()))
                bands.append(band_keys(h))
                packed.append(squeeze(text.encode("utf-8", "surrogatepass")))
            for k in range(lengths):
                found[k].append(signed(majority(remixed(h, k))))
        more = {"same": pa.array(same, pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64())), "packed": pa.array(packed, pa.binary())} if sets else {}
        return pa.RecordBatch.from_pydict({c: batch.column(c) for c in keep} | {f"s{k}": pa.array(x, pa.int64()) for k, x in enumerate(found)} | more)

    kinds = dict(docs.dtypes)
    more = ["same binary", "bands array<long>", "packed binary"] if sets else []
    return arrow_map(docs, run, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"s{k} long" for k in range(lengths)] + more))


def shingle_sets(members: DataFrame, words: int, seed: int) -> DataFrame:
    """``group, item, packed`` to ``group, item, shingles``: sorted hashes, 8 bytes each."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        unpack = zstandard.ZstdDecompressor().decompress
        own = [np.unique(shingle_hashes(unpack(x.as_py()).decode("utf-8", "surrogatepass"), words, seed)).astype("<u8").tobytes() for x in batch.column("packed")]
        return pa.RecordBatch.from_arrays([batch.column("group"), batch.column("item"), pa.array(own, pa.binary())], names=["group", "item", "shingles"])

    return arrow_map(members.select("group", "item", "packed"), run, "group long, item long, shingles binary")


class Forest:
    """Labels of a task's items; links between items of one label are not needed any more."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            open_ = a != b
            if not open_.any():
                return
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            low, high = np.minimum(a, b), np.maximum(a, b)
            parent = np.arange(len(self.label))
            np.minimum.at(parent, high, low)
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
            self.label = parent[self.label]


class Walk:
    """The joint walk over two sorted sets of keys (or one with itself)."""

    def __init__(self, a: np.ndarray, b: np.ndarray, sig: np.ndarray, ia: np.ndarray, ib: np.ndarray, bits: int, budget: int, total: int, forest: Forest):
        self.a, self.b, self.sig, self.ia, self.ib = a, b, sig, ia, ib
        self.bits, self.budget, self.total, self.forest = bits, budget, total, forest

    def compare(self, i: np.ndarray, j: np.ndarray) -> None:
        """Link items i and j (positions in ``sig``) within the budget of all bits."""
        open_ = self.forest.label[i] != self.forest.label[j]
        i, j = i[open_], j[open_]
        far = np.zeros(len(i), np.int64)
        for k in range(self.sig.shape[1]):
            far += np.bitwise_count(self.sig[i, k] ^ self.sig[j, k])
        near = far <= self.total
        self.forest.link(i[near], j[near])

    def products(self, alo, ahi, blo, bhi) -> None:
        """Compare all of each small range pair, a bounded number at a time."""
        na, nb = ahi - alo, bhi - blo
        size = na * nb
        for k in np.nonzero(size > WALK)[0]:
            self.large(self.ia[alo[k] : ahi[k]], self.ib[blo[k] : bhi[k]])
        small = size <= WALK
        alo, blo, nb, size = alo[small], blo[small], nb[small], size[small]
        cuts = np.searchsorted(np.cumsum(size), np.arange(WALK, int(size.sum()) + WALK, WALK)) + 1
        begin = 0
        for end in [*cuts.tolist(), len(size)]:
            end = min(end, len(size))
            if end <= begin:
                continue
            own = slice(begin, end)
            which = np.repeat(np.arange(end - begin), size[own])
            rank = np.arange(len(which)) - np.repeat(np.cumsum(size[own]) - size[own], size[own])
            self.compare(self.ia[alo[own][which] + rank // nb[own][which]], self.ib[blo[own][which] + rank % nb[own][which]])
            begin = end

    def large(self, i: np.ndarray, j: np.ndarray) -> None:
        """A product of crowded ranges: first each side's first item with all of the other, then only pairs of unequal labels."""
        self.compare(np.repeat(i[:1], len(j)), j)
        self.compare(i, np.repeat(j[:1], len(i)))
        for x in i.tolist():
            rest = j[self.forest.label[j] != self.forest.label[x]]
            if len(rest):
                self.compare(np.full(len(rest), x), rest)

    def run(self, same: bool) -> None:
        a, b = self.a, self.b
        if not len(a) or not len(b):
            return
        stack = [(self.bits, np.array([0]), np.array([len(a)]), np.array([0]), np.array([len(b)]), np.array([0]))]
        while stack:
            depth, alo, ahi, blo, bhi, diff = stack.pop()
            small = ((ahi - alo) * (bhi - blo) <= 32) | (depth == 0)
            if small.any():
                self.products(alo[small], ahi[small], blo[small], bhi[small])
                big = ~small
                alo, ahi, blo, bhi, diff = alo[big], ahi[big], blo[big], bhi[big], diff[big]
            if not len(alo):
                continue
            bit = np.uint64(1 << (depth - 1))
            high = ~((bit << np.uint64(1)) - np.uint64(1)) if depth < 64 else np.uint64(0)
            amid = np.clip(np.searchsorted(a, (a[alo] & high) | bit), alo, ahi)
            bmid = np.clip(np.searchsorted(b, (b[blo] & high) | bit), blo, bhi)
            # a pair of a node with itself needs (0, 1) but not (1, 0) as well
            crossed = np.ones(len(alo), bool) if not same else ~((alo == blo) & (ahi == bhi))
            parts = [(alo, amid, blo, bmid, diff), (amid, ahi, bmid, bhi, diff), (alo, amid, bmid, bhi, diff + 1), (amid[crossed], ahi[crossed], blo[crossed], bmid[crossed], diff[crossed] + 1)]
            al, ah, bl, bh, d = (np.concatenate(x) for x in zip(*parts, strict=True))
            keep = (ah > al) & (bh > bl) & (d <= self.budget)
            al, ah, bl, bh, d = al[keep], ah[keep], bl[keep], bh[keep], d[keep]
            for k in range(0, len(al), WALK):
                own = slice(k, k + WALK)
                stack.append((depth - 1, al[own], ah[own], bl[own], bh[own], d[own]))


def join_blocks(key_a, sig_a, key_b, sig_b, bits: int, budget: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest ``(item, label)`` of the links between two blocks (b None: within one); items count through a, then b."""
    oa = np.argsort(key_a, kind="stable")
    if key_b is None:
        forest = Forest(len(key_a))
        Walk(key_a[oa], key_a[oa], sig_a, oa, oa, bits, budget, total, forest).run(True)
    else:
        ob = np.argsort(key_b, kind="stable")
        forest = Forest(len(key_a) + len(key_b))
        Walk(key_a[oa], key_b[ob], np.concatenate([sig_a, sig_b]), oa, ob + len(key_a), bits, budget, total, forest).run(False)
    (moved,) = np.nonzero(forest.label != np.arange(len(forest.label)))
    return moved, forest.label[moved]


def segments(width: int, budget: int) -> list[tuple[int, int]]:
    """``(bits to turn left, bits of the segment)`` of ``budget + 1`` segments that make up a key."""
    ends = [width * k // (budget + 1) for k in range(budget + 2)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def trie_links(sigs: DataFrame, tables: list[tuple[int, int, int]], budget: int, total: int, block: int = BLOCK, crowd: int = CROWD) -> DataFrame:
    """``a, b``: links that connect all fingerprints within the budgets.

    sigs: distinct fingerprints ``rep, s0, ..``.  tables: (word, lowest bit, number of bits) of each
    key.  A pair links if its keys differ in at most ``budget`` bits in some table and all
    words in at most ``total``.
    """
    spark = sigs.sparkSession
    words = [c for c in sigs.columns if c != "rep"]
    n = sigs.count()
    (bits,) = {width for _, _, width in tables}  # tries of one depth
    turns = segments(bits, budget)
    top = min(min(size for _, size in turns), max(0, math.ceil(math.log2(max(1, n) / block))))
    # one block holds all pairs, whatever is on top
    tries = [(*table, turn) for table in tables for turn, _ in (turns if top else turns[:1])]

    def key_of(trie: Column) -> Column:
        """The bits of a trie's key, turned, as a signed long."""
        out = F.lit(0).cast("long")
        for t, (word, low, width, turn) in enumerate(tries):
            if width == 64:
                own = F.expr(f"(shiftleft(s{word}, {turn}) | shiftrightunsigned(s{word}, {64 - turn}))" if turn else f"s{word}")
            else:
                mask = (1 << width) - 1
                own = F.expr(f"shiftrightunsigned(s{word}, {low}) & {mask}L")
                own = F.expr(f"((shiftrightunsigned(s{word}, {low}) & {mask}L) << {turn} & {mask}L) | shiftrightunsigned(shiftrightunsigned(s{word}, {low}) & {mask}L, {width - turn})") if turn else own
            out = F.when(trie == t, own).otherwise(out)
        return out

    keyed = sigs.select(F.explode(F.array(*(F.lit(t) for t in range(len(tries))))).alias("t"), "rep", *words).withColumn("key", key_of(F.col("t")))

    def path(depth) -> str:
        return f"cast(shiftrightunsigned(key, {bits} - {depth}) as bigint)" if depth else "0L"

    # blocks that crowd are cut deeper, 3 bits at a time, by counts alone
    settled, depth, written = [], top, []
    open_ = keyed
    while True:
        blocks = open_.groupBy("t", F.expr(path(depth)).alias("path")).agg(F.count(F.lit(1)).alias("size"))
        fine = materialize(blocks, "trie-blocks")
        written.append(fine)
        crowded = fine.where(f"size > {crowd}")
        if depth + 3 >= bits or not crowded.limit(1).count():
            settled.append((depth, open_, None if depth == top else fine))
            break
        settled.append((depth, open_, fine.where(f"size <= {crowd}")))
        open_ = open_.withColumn("path", F.expr(path(depth))).join(crowded.select("t", "path"), ["t", "path"]).drop("path")
        depth += 3
    blobs = None
    for d, rows, own in settled:
        rows = rows.withColumn("path", F.expr(path(d)))
        rows = rows if own is None else rows.join(own.select("t", "path"), ["t", "path"], "left_semi")
        gathered = rows.groupBy("t", "path").agg(F.collect_list(F.struct("rep", *words)).alias("items")).withColumn("depth", F.lit(d))
        blobs = gathered if blobs is None else blobs.union(gathered)
    # a block's array holds ``crowd`` items at most, or what one path of all bits has
    blobs = materialize(blobs.withColumn("above", F.expr(f"cast(shiftrightunsigned(path, depth - {top}) as bigint)")).withColumn("block", F.xxhash64("t", "path", "depth")), "trie-items")
    discard(*written)

    def arrays(value) -> tuple[np.ndarray, np.ndarray]:
        # a ListScalar of structs
        own = value.values
        rep = own.field("rep").to_numpy(zero_copy_only=False)
        sig = np.stack([own.field(w).to_numpy(zero_copy_only=False) for w in words], axis=1).view(np.uint64)
        return rep, sig

    def keys(sig: np.ndarray, t: int) -> np.ndarray:
        word, low, width, turn = tries[t]
        k = sig[:, word] >> np.uint64(low)
        if width < 64:
            k = k & np.uint64((1 << width) - 1)
        if turn:
            k = (k << np.uint64(turn)) | (k >> np.uint64(width - turn))
        return k if width == 64 else k & np.uint64((1 << width) - 1)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, value in zip(batch.column("t").to_pylist(), batch.column("items"), strict=True):
                rep, sig = arrays(value)
                i, j = join_blocks(keys(sig, t), sig, None, None, bits, budget, total)
                yield pa.RecordBatch.from_pydict({"a": pa.array(rep[i], pa.int64()), "b": pa.array(rep[j], pa.int64())})

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, left, right in zip(batch.column("t").to_pylist(), batch.column("items"), batch.column("items2"), strict=True):
                (rep, sig), (rep2, sig2) = arrays(left), arrays(right)
                i, j = join_blocks(keys(sig, t), sig, keys(sig2, t), sig2, bits, budget, total)
                both = np.concatenate([rep, rep2])
                yield pa.RecordBatch.from_pydict({"a": pa.array(both[i], pa.int64()), "b": pa.array(both[j], pa.int64())})

    parts = max(2 * total_cores(spark), n * len(tries) // TASK)
    links = blobs.select("t", "items", "block").repartition(parts, "block").select("t", "items").mapInArrow(within, "a long, b long")
    links = materialize(links, "trie-links")
    if len(settled) > 1:
        heads = blobs.select("t", "path", "depth", "above", "block")
        other = heads.select("t", "above", *(F.col(c).alias(f"{c}2") for c in ("path", "depth", "block")))
        pairs = heads.join(other, ["t", "above"]).where(
            F.expr(f"bit_count(shiftrightunsigned(path, depth - least(depth, depth2)) ^ shiftrightunsigned(path2, depth2 - least(depth, depth2))) <= {budget}") & F.expr("(depth, path) < (depth2, path2)")
        )
        pairs = materialize(pairs.select("t", "block", "block2"), "trie-pairs")
        n_pairs = pairs.count()
        if n_pairs:
            items = blobs.select("block", "items")
            joined = pairs.join(items, "block").join(items.select(F.col("block").alias("block2"), F.expr("items").alias("items2")), "block2")
            joined = joined.repartition(max(2 * total_cores(spark), n_pairs // 4), "block", "block2").select("t", "items", "items2")
            more = materialize(joined.mapInArrow(between, "a long, b long"), "trie-links")
            both = materialize(links.union(more), "trie-links")
            discard(links, more)
            links = both
        discard(pairs)
    discard(blobs)
    return links


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def band_links(items: DataFrame) -> DataFrame:
    """``a, b``: each of ``item, bands`` with the least item that shares a band."""
    keyed = items.select("item", F.explode("bands").alias("key"))
    first = materialize(keyed.groupBy("key").agg(F.min("item").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "simhash-bands-first")
    return keyed.join(first, "key").where("item <> least").select(F.col("item").alias("a"), F.col("least").alias("b")).distinct()


def alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets of hashes is ``least`` or more."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or len(x) < least * len(y) - 1e-9:
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return both >= least * (len(x) + len(y) - both) - 1e-9


def exact_links(members: DataFrame, least: float) -> DataFrame:
    """``a, b``: links that connect all items of a class whose sets are alike, of ``group, item, shingles``."""

    def ordered(data: bytes) -> np.ndarray:
        return np.frombuffer(data, "<u8")

    def with_leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for item, own, leaders in zip(batch.column("item").to_pylist(), batch.column("shingles"), batch.column("leaders"), strict=True):
                x = ordered(own.as_py())
                for leader in leaders.as_py():
                    if leader["item"] != item and alike(x, ordered(leader["shingles"]), least):
                        a.append(item)
                        b.append(leader["item"])
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def of_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                left = [(r["item"], r["label"], ordered(r["shingles"])) for r in batch.column("left")[k].as_py()]
                right = [(r["item"], r["label"], ordered(r["shingles"])) for r in batch.column("right")[k].as_py()]
                # links found on the way join labels, so that a dense group needs few comparisons
                up: dict[int, int] = {}

                def root(x: int, up: dict[int, int] = up) -> int:
                    while x in up:
                        x = up[x]
                    return x

                a, b = [], []
                for i, own, x in left:
                    for j, other, y in right:
                        p, q = root(own), root(other)
                        if p != q and alike(x, y, least):
                            up[max(p, q)] = min(p, q)
                            a.append(i)
                            b.append(j)
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    order = Window.partitionBy("group").orderBy(F.xxhash64("item"), "item")
    chosen = members.select("group", "item").withColumn("n", F.row_number().over(order)).where(F.col("n") <= LEADERS).select("item")
    leaders = members.join(chosen, "item", "left_semi").groupBy("group").agg(F.collect_list(F.struct("item", "shingles")).alias("leaders"))
    leaders = materialize(leaders, "simhash-leaders")
    links = materialize(members.join(leaders, "group").select("item", "shingles", "leaders").mapInArrow(with_leaders, "a long, b long"), "simhash-leader-links")
    discard(leaders)
    # in classes no larger than the leaders all pairs are done
    large = materialize(members.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LEADERS), "simhash-large")
    if not large.limit(1).count():
        discard(large)
        return links
    labels = connected_components(links)
    open_ = members.select("group", "item").join(large, "group").join(labels, F.col("item") == F.col("node"), "left").select("group", "n", "item", F.coalesce("component", "item").alias("label"))
    open_ = materialize(open_, "simhash-labelled")
    sizes = open_.groupBy("group", "label").agg(F.count(F.lit(1)).alias("own"), F.first("n").alias("n"))
    main = materialize(sizes.groupBy("group").agg(F.max(F.struct("own", "label", "n")).alias("x")).where("x.own < x.n").select("group", F.col("x.label").alias("main"), (F.col("x.n") - F.col("x.own")).alias("others")), "simhash-main")
    discard(large, labels)
    if not main.limit(1).count():
        discard(open_, main)
        return links
    # sets travel again only in classes that the leaders have not joined
    rows = materialize(open_.join(main, "group").join(members.select("item", "shingles"), "item"), "simhash-open")
    discard(open_, main)

    def chunks(own: DataFrame, size: str, name: str) -> DataFrame:
        chunk = F.expr(f"pmod(xxhash64(item), ceil({size} / {CHUNK}))")
        return materialize(own.groupBy("group", chunk.alias("chunk")).agg(F.collect_list(F.struct("item", "label", "shingles")).alias(name)).drop("chunk"), f"simhash-{name}")

    # a pair of unequal labels has an end outside the class's main label
    left, right = chunks(rows.where("label <> main"), "others", "left"), chunks(rows, "n", "right")
    found = materialize(left.join(right, "group").select("left", "right").mapInArrow(of_chunks, "a long, b long"), "simhash-chunk-links")
    both = materialize(links.union(found), "simhash-exact-links")
    discard(rows, left, right, links, found)
    return both


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 3, seed: int = 42, budget: int = 2, tables: list[tuple[int, int, int]] | None = None, total: int | None = None, lengths: int = 1, block: int = BLOCK, similarity: float | None = None) -> DataFrame:
    """``doc_id, row, digest, s0.., component_id, class``: the least id that links reach; a number of its own for each row and for each class.

    similarity: links also need this Jaccard similarity of the sets of shingles, and bands propose links beside the tries.
    """
    docs = keyed_text(df, id_col, text_col).withColumn("row", F.monotonically_increasing_id()).withColumn("digest", _digest(F.col("text")))
    sigs = [f"s{k}" for k in range(lengths)]
    rows = materialize(fingerprints(docs, words, seed, lengths, similarity is not None), "simhash-rows")
    keys = sigs if similarity is None else ["same"]
    # null ids: a class without any other id keeps a null name; numbers below every id stand in while links are followed
    own = rows.groupBy(*keys).agg(F.min("doc_id").alias("least"), F.min("row").alias("rep"), *(F.first(s).alias(s) for s in sigs if s not in keys))
    distinct = materialize(own, "simhash-distinct")
    links = trie_links(distinct.select("rep", *sigs), tables or [(0, 0, 64)], budget, budget if total is None else total, block)
    if similarity is not None:
        items = rows.join(distinct.select(F.col("rep").alias("row")), "row", "left_semi").select(F.col("row").alias("item"), "bands")
        proposals = materialize(links.union(band_links(items)), "simhash-proposals")
        proposed = connected_components(proposals)
        # texts of proposed classes alone
        texts = rows.select("row", "packed").join(proposed, F.col("row") == F.col("node")).select(F.col("component").alias("group"), F.col("row").alias("item"), "packed")
        members = materialize(shingle_sets(texts, words, seed), "simhash-members")
        discard(links, proposals, proposed)
        links = exact_links(members, similarity)
        discard(members)
    groups = connected_components(links)
    named = distinct.join(groups, distinct["rep"] == groups["node"], "left").select(*keys, "least", F.coalesce("component", "rep").alias("component"))
    named = materialize(named, "simhash-named")
    # written as well, so that the join by component stands alone
    names = materialize(named.groupBy("component").agg(F.min("least").alias("component_id")), "simhash-names")
    discard(links, groups, distinct)
    classes = named.join(names, "component").select(*keys, "component_id", F.col("component").alias("class"))
    out = rows.select("doc_id", "row", "digest", *sigs, *(k for k in keys if k not in sigs)).join(classes, keys).drop("same")
    out._reads = (rows, named, names)
    return out


def simhash_query(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 3, seed: int = 42, budget: int = 2) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    out = simhash_components(df, id_col, text_col, words=words, seed=seed, budget=budget)
    return out.select("doc_id", F.lower(F.lpad(F.hex("s0"), 16, "0")).alias("fingerprint"), "component_id")


#: Near-duplicates: five-word shingles, Jaccard similarity 0.8 or more, checked on the sets.  Texts of similarity 0.8
#: differ in a share acos(2*0.8/1.8)/pi = 0.151 of their bits, 29 +- 5 of 192: six tries of 32 bits each with 3 to spare propose pairs
#: of up to 45 bits, and the bands propose what the tries miss.
NEAR = {"words": 5, "seed": 42, "budget": 3, "tables": [(k, low, 32) for k in range(3) for low in (0, 32)], "total": 45, "lengths": 3, "similarity": 0.8}


def near_duplicate_survivors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``df``, one of each class of near-duplicates: that of the least id, then of the first row.

    Rows are told apart by id and text digest; of rows that share both, one stays.
    """
    how = NEAR | how
    # both sides written, so the join stands alone and AQE can split a large class
    found = simhash_components(df, id_col, text_col, **how)
    marks = materialize(found.select("doc_id", "digest", "row", "class"), "simhash-marks")
    discard(*found._reads)
    first = materialize(marks.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row")).alias("x")), "simhash-first")
    verdict = materialize(marks.join(first, "class").select("doc_id", "digest", (F.col("row") != F.col("x.row")).alias("gone")), "simhash-verdict")
    discard(marks, first)
    gone = verdict.where("gone").select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest")).distinct()
    kept = verdict.where("not gone").select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest"))
    again = materialize(gone.join(kept, F.col("gone_id").eqNullSafe(F.col("kept_id")) & (F.col("gone_digest") == F.col("kept_digest")), "left_semi"), "simhash-repeated")
    # the input's columns travel by number, so none of their names can clash
    names = [f"c{k}" for k in range(len(df.columns))]
    keyed = df.select(df[id_col].cast("long").alias("id"), _digest(df[text_col]).alias("digest"), *(df[c].alias(n) for c, n in zip(df.columns, names, strict=True)))
    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("digest") == F.col("gone_digest"))
    single = keyed.join(gone, same, "left_anti")
    if again.limit(1).count():
        single = single.unionByName(keyed.join(again, same, "left_semi").dropDuplicates(["id", "digest"]))
    return single.select(*names).toDF(*df.columns)
