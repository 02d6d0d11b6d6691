"""Token-id files coded by a static range asymmetric numeral system (rANS).

One table of symbol frequencies, counted over all documents, serves all files.
A shard is a file of frames; a frame holds whole documents (about ``FRAME`` tokens) as

    magic "RANSFRM1" | n_docs u32 | n_tokens u64 | n_blocks u32 | table crc u32
    doc ids i64[n_docs] | null flags u8[n_docs] | lengths u64[n_docs]
    blocks, each: n_tokens u32 | n_words u32 | n_checkpoints u32 | crc32 of ids u32
                  | first states u64[lanes] | checkpoints (step u32, word u32, states u64[lanes])*
                  | words u32[n_words]

Blocks are independent: ``BLOCK`` tokens dealt to ``LANES`` interleaved coders that share one
stream of 32-bit words.  The manifest (one row a frame: file, offset, length, tokens before
it) lets any number of tasks decode frames at once; a block's checkpoints let a reader start
in its middle, and its checksum is verified on reading.

States are 64-bit with lower bound 2**32, frequencies add up to 2**20, so a coder gives or
takes at most one word a token.  Files are written under a name of their own for each attempt
and only files in the committed manifest are read, so a lost executor leaves at most an orphan.

Defined cases: a null text counts as empty and gives the end id alone; rows with a null id
come first and keep a null id; repeated ids are kept in a row; an empty table gives no file
and an empty result; a token that the table doesn't know raises ``ValueError``.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specaudit.llm.common import discard, keyed_text, materialize, shared_dir, total_cores
from specaudit.llm.pieces import encoder, text_slices

MAGIC = b"RANSFRM1"
SCALE = 20
LOWER = np.uint64(1 << 32)
LANES = 128
BLOCK = 1 << 16
FRAME = 1 << 21
CHECKPOINT_STEPS = 256
U = np.uint64


class Table:
    """Frequencies that add up to ``2**SCALE``; every counted symbol has one at least."""

    def __init__(self, symbols: np.ndarray, freqs: np.ndarray):
        self.symbols = symbols.astype(np.uint32)
        size = int(symbols.max()) + 1 if len(symbols) else 1
        self.freq = np.zeros(size, np.uint64)
        self.freq[symbols] = freqs
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.slots = np.repeat(np.arange(size, dtype=np.uint32), self.freq.astype(np.int64))
        self.crc = zlib.crc32(self.symbols.tobytes() + freqs.astype("<u4").tobytes())

    @classmethod
    def of_counts(cls, symbols, counts) -> Table:
        symbols, counts = np.asarray(symbols, np.int64), np.asarray(counts, np.float64)
        order = np.argsort(symbols)
        symbols, counts = symbols[order], counts[order]
        if len(symbols) == 1:  # a lone symbol may not fill the whole range
            other = int(symbols[0]) + 1
            symbols, counts = np.append(symbols, other), np.append(counts, 0)
        if len(symbols) > 1 << (SCALE - 1):
            raise ValueError(f"{len(symbols)} symbols are too many for tables of 2**{SCALE}")
        total = 1 << SCALE
        spare = total - len(symbols)
        freqs = 1 + np.floor(counts / counts.sum() * spare).astype(np.int64)
        freqs[np.argmax(freqs)] += total - freqs.sum()
        return cls(symbols, freqs.astype(np.uint64))

    def to_bytes(self) -> bytes:
        return struct.pack("<I", len(self.symbols)) + self.symbols.astype("<u4").tobytes() + self.freq[self.symbols].astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        (n,) = struct.unpack_from("<I", data)
        return cls(np.frombuffer(data, "<u4", n, 4).astype(np.int64), np.frombuffer(data, "<u4", n, 4 + 4 * n).astype(np.uint64))


def encode_blocks(tokens: np.ndarray, table: Table, lanes: int = LANES, block: int = BLOCK, checkpoint: int = CHECKPOINT_STEPS) -> list[bytes]:
    """The blocks of a stream of ids; all blocks advance together, one vector operation a step."""
    n = len(tokens)
    if not n:
        return []
    if int(tokens.max()) >= len(table.freq) or not table.freq[tokens].all():
        raise ValueError("a token is not in the frequency table")
    n_blocks = -(-n // block)
    sizes = [min(block, n - k * block) for k in range(n_blocks)]
    steps = [-(-s // lanes) for s in sizes]
    top = max(steps)
    filler = int(table.symbols[np.argmax(table.freq[table.symbols])])
    grid = np.full((top, n_blocks, lanes), filler, np.int64)
    for k, (size, rows) in enumerate(zip(sizes, steps, strict=True)):
        own = np.full(rows * lanes, filler, np.int64)
        own[:size] = tokens[k * block : k * block + size]
        grid[:rows, k] = own.reshape(rows, lanes)
    grid = grid.reshape(top, n_blocks * lanes)
    state = np.full(n_blocks * lanes, LOWER, np.uint64)
    words = np.zeros((top, n_blocks * lanes), np.uint32)
    gave = np.zeros((top, n_blocks * lanes), bool)
    marks: dict[int, np.ndarray] = {}
    for s in range(top - 1, -1, -1):
        # only the last block can be shorter
        width = n_blocks * lanes if s < steps[-1] else (n_blocks - 1) * lanes
        sym = grid[s, :width]
        f, c, x = table.freq[sym], table.start[sym], state[:width]
        over = x >= (f << U(64 - SCALE))
        words[s, :width] = (x & U(0xFFFFFFFF)).astype(np.uint32)
        gave[s, :width] = over
        x = np.where(over, x >> U(32), x)
        q = x // f
        state[:width] = (q << U(SCALE)) + (x - q * f) + c
        if s and s % checkpoint == 0:
            marks[s] = state.copy()
    out = []
    for k in range(n_blocks):
        own = slice(k * lanes, (k + 1) * lanes)
        took = gave[: steps[k], own]
        stream = words[: steps[k], own][took]
        before = np.concatenate([[0], np.cumsum(took.sum(axis=1))])
        at = [s for s in sorted(marks) if s < steps[k]]
        ids = np.ascontiguousarray(tokens[k * block : k * block + sizes[k]], "<u4")
        out.append(
            struct.pack("<IIII", sizes[k], len(stream), len(at), zlib.crc32(ids.tobytes()))
            + state[own].astype("<u8").tobytes()
            + b"".join(struct.pack("<II", s, int(before[s])) + marks[s][own].astype("<u8").tobytes() for s in at)
            + stream.astype("<u4").tobytes()
        )
    return out


class Block:
    """A coded block, parsed but not decoded."""

    def __init__(self, data: memoryview, offset: int, lanes: int):
        self.n, n_words, n_marks, self.crc = struct.unpack_from("<IIII", data, offset)
        at = offset + 16
        self.first = np.frombuffer(data, "<u8", lanes, at)
        at += 8 * lanes
        self.marks = {}
        for _ in range(n_marks):
            step, word = struct.unpack_from("<II", data, at)
            self.marks[step] = (word, np.frombuffer(data, "<u8", lanes, at + 8))
            at += 8 + 8 * lanes
        self.words = np.frombuffer(data, "<u4", n_words, at)
        self.end = at + 4 * n_words


def decode_blocks(blocks: list[Block], table: Table, lanes: int = LANES, start: int = 0) -> list[np.ndarray]:
    """Ids of the blocks from step ``start`` on (0 or a checkpoint of every block); checksums are verified for whole blocks."""
    if not blocks:
        return []
    order = sorted(range(len(blocks)), key=lambda k: -blocks[k].n)
    own = [blocks[k] for k in order]
    steps = np.array([-(-b.n // lanes) for b in own])
    base = np.concatenate([[0], np.cumsum([len(b.words) for b in own])[:-1]]).astype(np.int64)
    words = np.concatenate([b.words for b in own] + [np.zeros(1, np.uint32)])
    if start:
        base = base + np.array([b.marks[start][0] for b in own])
    state = np.concatenate([b.marks[start][1] if start else b.first for b in own]).astype(np.uint64)
    top = int(steps[0])
    out = np.zeros((max(0, top - start), len(own) * lanes), np.uint32)
    mask = U((1 << SCALE) - 1)
    for s in range(start, top):
        live = int((steps > s).sum())
        width = live * lanes
        x = state[:width]
        slot = x & mask
        sym = table.slots[slot.astype(np.int64)]
        out[s - start, :width] = sym
        x = table.freq[sym] * (x >> U(SCALE)) + slot - table.start[sym]
        need = x < LOWER
        rank = np.cumsum(need.reshape(live, lanes), axis=1)
        at = (base[:live, None] + rank - 1).reshape(-1)
        x = np.where(need, (x << U(32)) | words[np.where(need, at, 0)].astype(np.uint64), x)
        base[:live] += rank[:, -1]
        state[:width] = x
    ids: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(blocks)
    for j, k in enumerate(order):
        got = np.ascontiguousarray(out[: max(0, int(steps[j]) - start), j * lanes : (j + 1) * lanes]).reshape(-1)[: max(0, blocks[k].n - start * lanes)]
        if not start and zlib.crc32(got.astype("<u4").tobytes()) != blocks[k].crc:
            raise ValueError("checksum of a block does not hold")
        ids[k] = got
    return ids


def encode_frame(doc_ids: list[int | None], lengths: list[int], tokens: np.ndarray, table: Table) -> bytes:
    part = 32 * BLOCK  # blocks coded together
    blocks = [b for k in range(0, len(tokens), part) for b in encode_blocks(tokens[k : k + part].astype(np.int64), table)]
    return (
        MAGIC
        + struct.pack("<IQII", len(lengths), len(tokens), len(blocks), table.crc)
        + np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
        + np.array([d is None for d in doc_ids], np.uint8).tobytes()
        + np.array(lengths, "<u8").tobytes()
        + b"".join(blocks)
    )


def decode_frame(data: bytes, table: Table, lanes: int = LANES, at_once: int = 32) -> Iterator[tuple[int | None, int, bytes]]:
    """``doc_id, n_tokens, ids`` of each document; ``at_once`` blocks are decoded together."""
    view = memoryview(data)
    if data[:8] != MAGIC:
        raise ValueError("not a frame")
    n_docs, n_tokens, n_blocks, crc = struct.unpack_from("<IQII", data, 8)
    if crc != table.crc:
        raise ValueError("the frame belongs to another frequency table")
    at = 28
    doc_ids = np.frombuffer(data, "<i8", n_docs, at)
    null = np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs)
    lengths = np.frombuffer(data, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
    at += 17 * n_docs
    blocks = []
    for _ in range(n_blocks):
        blocks.append(Block(view, at, lanes))
        at = blocks[-1].end
    parts = [decode_blocks(blocks[k : k + at_once], table, lanes) for k in range(0, n_blocks, at_once)]
    ids = np.concatenate([x for part in parts for x in part]) if parts else np.zeros(0, np.uint32)
    if len(ids) != n_tokens:
        raise ValueError("a frame is short of tokens")
    begin = 0
    for d, missing, n in zip(doc_ids.tolist(), null.tolist(), lengths.tolist(), strict=True):
        yield (None if missing else d), n, ids[begin : begin + n].astype("<u4").tobytes()
        begin += n


def _squeeze(ids: np.ndarray) -> bytes:
    """Ids for the way between two jobs: two bytes each where that suffices, compressed."""
    small = not len(ids) or int(ids.max()) < 1 << 16
    return (b"2" if small else b"4") + zstandard.ZstdCompressor(level=1).compress(ids.astype("<u2" if small else "<u4").tobytes())


def _unsqueeze(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), "<u2" if data[:1] == b"2" else "<u4")


FRAMES = "shard int, frame int, doc_ids array<long>, lengths array<long>, ids binary, tokens array<int>, counts array<int>"


def tokenized_frames(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 2, frame_tokens: int = FRAME) -> DataFrame:
    """Frames of whole documents in ascending id order, tokenised once: by shard, then by frame."""
    docs = keyed_text(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(vocabulary, True)
        doc_ids: list[int | None] = []
        coded: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        held = shard = frame = 0

        def out() -> pa.RecordBatch:
            sizes, data = np.concatenate(lengths), np.concatenate(coded)
            seen = np.bincount(data)
            (used,) = np.nonzero(seen)
            own = {"shard": pa.array([shard], pa.int32()), "frame": pa.array([frame], pa.int32()), "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())), "lengths": pa.array([sizes], pa.list_(pa.int64())), "ids": pa.array([_squeeze(data)], pa.binary())}
            own |= {k: pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for k, x in (("tokens", used), ("counts", seen[used]))}
            return pa.RecordBatch.from_pydict(own)

        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column("shard")[0].as_py()
            own = batch.column("doc_id").to_pylist()
            for at, texts in text_slices(batch.column("text")):
                ids, sizes = code.encode_column(texts)
                upto = np.cumsum(sizes + 1)
                ids, sizes = np.insert(ids, upto - 1 - np.arange(len(upto)), end_id), sizes + 1
                done = 0
                while done < len(sizes):
                    # documents up to the one that fills the frame
                    before = int(upto[done - 1]) if done else 0
                    last = min(len(sizes), int(np.searchsorted(upto, before + frame_tokens - held)) + 1)
                    coded.append(ids[before : int(upto[last - 1])])
                    lengths.append(sizes[done:last])
                    doc_ids += own[at + done : at + last]
                    held += len(coded[-1])
                    done = last
                    if held >= frame_tokens:
                        yield out()
                        doc_ids, coded, lengths, held, frame = [], [], [], 0, frame + 1
        if doc_ids:
            yield out()

    # the row number parts ranges within an id too, however often the id is repeated
    order = [F.col("doc_id").asc_nulls_first(), F.col("row")]
    ordered = docs.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("row").withColumn("shard", F.spark_partition_id())
    return materialize(ordered.mapInArrow(run, FRAMES), "token-frames")


def token_counts(frames: DataFrame) -> DataFrame:
    """``token_id, n`` over all documents, from each frame's own counts; sums leave each task as one row a token."""
    pairs = frames.select(F.explode(F.arrays_zip("tokens", "counts")).alias("c"))
    return pairs.groupBy(F.col("c.tokens").alias("token_id")).agg(F.sum("c.counts").alias("n"))


MANIFEST = "shard int, frame int, path string, offset long, size long, n_docs long, n_tokens long"


def write_token_files(df: DataFrame, vocabulary: str, folder: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 2, frame_tokens: int = FRAME) -> tuple[DataFrame, bytes]:
    """Encode every text in ascending id order to files in ``folder``; gives the manifest with ``start`` (tokens before a frame) and the frequency table."""
    frames = tokenized_frames(df, vocabulary, id_col, text_col, end_id=end_id, frame_tokens=frame_tokens)
    counts = token_counts(frames).collect()  # at most one row a symbol of the vocabulary
    table = Table.of_counts([r[0] for r in counts], [r[1] for r in counts]) if counts else Table.of_counts([end_id], [1])
    packed = table.to_bytes()
    broadcast = df.sparkSession.sparkContext.broadcast(packed)  # 8 bytes a symbol

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table.from_bytes(broadcast.value)
        store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        rows: list[tuple] = []
        sink, path, at, open_shard = None, "", 0, None
        for batch in batches:
            for shard, frame, doc_ids, lengths, ids in zip(*(batch.column(k) for k in range(5)), strict=True):
                shard = shard.as_py()
                if sink is None or shard != open_shard:
                    # a shard may be read in several parts: each is a file of its own
                    if sink is not None:
                        sink.close()
                    store.create_dir(root, recursive=True)
                    path, at, open_shard = f"{root}/tokens-{shard:06d}-{uuid.uuid4().hex}.rans", 0, shard
                    sink = store.open_output_stream(path)
                tokens, sizes = _unsqueeze(ids.as_py()), lengths.as_py()
                data = encode_frame(doc_ids.as_py(), sizes, tokens, table)
                sink.write(data)
                rows.append((shard, frame.as_py(), path, at, len(data), len(sizes), len(tokens)))
                at += len(data)
        if sink is not None:
            sink.close()
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in rows], kind) for k, (n, kind) in enumerate(zip(names, kinds, strict=True))})

    manifest = materialize(frames.select("shard", "frame", "doc_ids", "lengths", "ids").mapInArrow(write, MANIFEST), "token-manifest")
    discard(frames)
    # shards are few (one a partition), so their running total may be one task's
    shards = manifest.groupBy("shard").agg(F.sum("n_tokens").alias("t"))
    before = shards.select("shard", (F.sum("t").over(Window.orderBy("shard")) - F.col("t")).alias("base"))
    inner = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("frame")) - F.col("n_tokens")
    return manifest.withColumn("inner", inner).join(before, "shard").select(*manifest.columns, (F.col("base") + F.col("inner")).alias("start")), packed


def read_token_files(manifest: DataFrame, table: bytes, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` read back from the files, frames dealt to all tasks."""
    broadcast = manifest.sparkSession.sparkContext.broadcast(table)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table.from_bytes(broadcast.value)
        store, _ = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(row["path"]) as f:
                    f.seek(row["offset"])
                    data = f.read(row["size"])
                out = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                start = row["start"]
                for doc_id, n, ids in decode_frame(data, table):
                    for k, v in zip(out, (doc_id, start, n, zlib.crc32(ids)), strict=True):
                        out[k].append(v)
                    start += n
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

    parts = max(2 * total_cores(manifest.sparkSession), manifest.count() // 16)
    return manifest.repartition(parts, "shard", "frame").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digest(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 2) -> DataFrame:
    """Write the token files of ``df`` to the shared folder, read them back, and report what they hold of each document."""
    folder = f"{shared_dir(df.sparkSession)}/token-files-{uuid.uuid4().hex}"
    manifest, table = write_token_files(df, vocabulary, folder, id_col, text_col, end_id=end_id)
    return read_token_files(materialize(manifest, "token-index"), table, folder)
