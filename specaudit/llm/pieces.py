"""Exact tokenisation of Arrow columns, piece by piece."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Classes of bytes.  Runs of letters, digits and marks are pre-tokens of their own in both vocabularies; the apostrophe begins
#: contractions, control characters and other scripts' bytes may go with what stands beside them.
SPACE, LETTER, DIGIT, MARK, LOOSE, HIGH, LEAD, CONTROL = range(8)
CLASS = np.full(256, MARK, np.uint8)
CLASS[:32] = LOOSE
CLASS[[39, 127]] = LOOSE
CLASS[[32, 10]] = SPACE
CLASS[48:58] = DIGIT
CLASS[65:91] = CLASS[97:123] = LETTER
CLASS[128:] = HIGH
#: White space other than the blank and the line feed: texts that hold any are not cut.
CLASS[[9, 11, 12, 13, 28, 29, 30, 31]] = CONTROL
CLASS[[0xC2, 0xE1, 0xE2, 0xE3]] = LEAD
WIDE_SPACES = frozenset("\x85\xa0                　")
#: A code for each kind of neighbours that part: different classes of letter, digit and mark.
PARTS = np.zeros((8, 8), bool)
PARTS[1:4, 1:4] = ~np.eye(3, dtype=bool)
#: White space begins a piece, unless white space stands before it.
PARTS[1:, SPACE] = True
PARTS = PARTS.ravel()
#: Pieces that are looked up at once, and bytes of the longest piece that is remembered.
PIECES, LONGEST = 1 << 20, 64


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without nulls, and where each text begins and the last one ends."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def text_slices(column: pa.Array, budget: int = 4_000_000) -> Iterator[tuple[int, pa.Array]]:
    """A string column in runs of about ``budget`` bytes, each with the row it begins at."""
    _, at = column_bytes(column)
    begin = 0
    while begin < len(column):
        end = min(len(column), max(begin + 1, int(np.searchsorted(at, at[begin] + budget))))
        yield begin, column.slice(begin, end - begin)
        begin = end


class PieceEncoder:
    """Ids as the tokenizers library's default call gives them, with a bounded memo of pieces.

    A text is cut where a pre-token always ends: before white space behind a visible character, behind a line feed that
    stands alone, and between ASCII letters, digits and marks.  Arrow finds the distinct pieces of a run of texts, the library encodes
    each once a worker, many in one call, and a text's ids are gathered from its pieces'.
    Texts with other white space are one piece, and texts that hold the literal of an added token are encoded whole.
    ``blank_prefix``: a blank belongs to the word behind it (byte-level vocabularies); otherwise the vocabulary drops white
    space and folds case, and ASCII capitals are folded first (not before a combining character, which may compose with one case only).
    The memo has two halves of about ``limit`` pieces: when one is full the older goes.
    """

    def __init__(self, path: str, *, blank_prefix: bool, limit: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.literals = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.blank_prefix, self.limit = blank_prefix, limit
        self.memo: dict[bytes, bytes] = {b"": b""}
        self.old: dict[bytes, bytes] = {}
        # a sign of one id that stands between pieces encoded in one call
        marks = ["\n"] if blank_prefix else [f" {m} " for m in "¬¦§¶¤°±"]
        self.mark, self.mark_id = next((m, ids[0]) for m in marks if len(ids := self.tokenizer.encode(m, add_special_tokens=False).ids) == 1)
        self.sign = self.mark.strip() or self.mark

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece; plain ones go in one call, parted by the mark."""
        texts = [p.decode("utf-8", "surrogatepass") for p in pieces]
        # white space at an end could join the mark's
        plain = [self.sign not in t and not t[-1].isspace() and not t[t[0] == " "].isspace() for t in texts]
        out: list[bytes] = [b""] * len(pieces)
        runs = [k for k, x in enumerate(plain) if x]
        for at in range(0, len(runs), 5_000):
            part = runs[at : at + 5_000]
            joined = self.mark.join([texts[k] for k in part])
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * np.flatnonzero(ids == self.mark_id)).tolist()
            data = ids.tobytes()
            if len(ends) != len(part) - 1:
                raise AssertionError("a piece holds the mark")
            for k, i, j in zip(part, [0, *(e + 4 for e in ends)], [*ends, len(data)], strict=True):
                out[k] = data[i:j]
        odd = [k for k, x in enumerate(plain) if not x]
        for k, ids in zip(odd, self.whole([texts[k] for k in odd]) if odd else [], strict=True):
            out[k] = ids
        return out

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        if len(self.memo) > self.limit:
            # pieces in use come back from the older half
            self.memo, self.old = {b"": b""}, self.memo
        memo = self.memo
        found = list(map(memo.get, words))
        holes = [k for k, x in enumerate(found) if x is None]
        if self.old and holes:
            back = self.old.get
            for k in holes:
                if (ids := back(words[k])) is not None:
                    found[k] = memo[words[k]] = ids
            holes = [k for k in holes if found[k] is None]
        if holes:
            own = [words[k] for k in holes]
            ids = self._learn(own)
            memo.update((w, x) for w, x in zip(own, ids, strict=True) if len(w) <= LONGEST)
            for k, x in zip(holes, ids, strict=True):
                found[k] = x
        return found

    def _cuts(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes, folded where that is safe, and where each piece begins."""
        kind = CLASS[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = PARTS[(kind[:-1] << 3) | kind[1:]]
        feed = np.flatnonzero(data[:-1] == 10)
        begins = np.zeros(len(data) + 1, bool)
        begins[at] = True
        alone = (begins[feed] | (kind[feed - 1] != SPACE)) & (kind[feed + 1] != SPACE)
        cut[feed[alone] + 1] = True
        uncut = np.flatnonzero(kind == CONTROL)
        lead = np.flatnonzero(kind == LEAD)
        if len(lead):
            wide = [k for k in lead.tolist() if data[k : k + 3].tobytes().decode("utf-8", "ignore")[:1] in WIDE_SPACES]
            uncut = np.concatenate([uncut, np.array(wide, np.int64)])
        fold = np.zeros(len(data), bool)
        if not self.blank_prefix:
            fold = (data >= 65) & (data <= 90)
            fold[:-1] &= data[1:] < 128
        for k in np.unique(np.searchsorted(at, uncut, "right") - 1).tolist():
            # what is not cut stays as it is: folded, it could hold the literal of an added token
            cut[at[k] : at[k + 1]] = fold[at[k] : at[k + 1]] = False
        if not self.blank_prefix:
            data = data + (fold.view(np.uint8) << 5)
        cut[at[:-1][at[:-1] < len(data)]] = True
        return data, np.flatnonzero(cut)

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        held = column_bytes(column)[0].tobytes()
        if any(x.encode() in held for x in self.literals):
            return self._with_literals(column)
        return self._by_pieces(column)

    def _by_pieces(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, at = column_bytes(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
        folded, cuts = self._cuts(data, at)
        own = pa.py_buffer(np.ascontiguousarray(folded))
        sizes, ids = [], []
        for k in range(0, len(cuts), PIECES):
            ends = np.append(cuts[k : k + PIECES], cuts[k + PIECES] if k + PIECES < len(cuts) else len(data))
            pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), own]).dictionary_encode()
            which = pieces.indices.to_numpy()
            known = self._ids_of(pieces.dictionary.to_pylist())
            flat = np.frombuffer(b"".join(known), "<u4")
            size = np.fromiter(map(len, known), np.int64, len(known)) >> 2
            begin = np.cumsum(size) - size
            n = size[which]
            upto = np.cumsum(n)
            ids.append(flat[np.repeat(begin[which] - upto + n, n) + np.arange(int(upto[-1]))])
            sizes.append(n)
        total = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return np.concatenate(ids), np.diff(total[np.searchsorted(cuts, at)])

    def _with_literals(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = column.to_pylist()
        marked = [k for k, t in enumerate(texts) if any(x in t for x in self.literals)]
        apart = dict(zip(marked, self.whole([texts[k] for k in marked]), strict=True))
        ids, sizes = self._by_pieces(pa.array(["" if k in apart else t for k, t in enumerate(texts)], pa.string()))
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        for k, x in apart.items():
            parts[k] = np.frombuffer(x, "<u4")
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, sizes = self.encode_column(pa.array(texts, pa.string()))
        ends = np.cumsum(sizes).tolist()
        data = ids.astype("<u4").tobytes()
        return [data[4 * (e - n) : 4 * e] for e, n in zip(ends, sizes.tolist(), strict=True)]


#: Pieces that half a memo holds: about 100 MB a worker for both halves.
MEMO_WORDS = 300_000
_encoders: dict[tuple[str, bool, int], PieceEncoder] = {}


def encoder(path: str, blank_prefix: bool, memo_words: int = MEMO_WORDS) -> PieceEncoder:
    """One encoder for each worker process, vocabulary and size of memo."""
    key = (path, blank_prefix, memo_words)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(path, blank_prefix=blank_prefix, limit=memo_words)
    return _encoders[key]
