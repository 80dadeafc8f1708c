"""Harmonic packing of token sequences.

Every document is tokenised and cut into pieces: whole sequences of ``CAPACITY`` tokens, then of what remains the
powers of two from CAPACITY/2 down to ``LEAST`` that fit, then the rest (below ``LEAST``). A piece belongs to the
class k = floor(CAPACITY / length), its length lies in (CAPACITY/(k+1), CAPACITY/k], and a bin of class k takes
exactly k pieces, so it needs no search and no knowledge of other workers: each task fills its own bins. Bins of
the power-of-two classes are full to the last token; a bin of a rest wastes below CAPACITY/(k+1) tokens, under
``LEAST``. What a task's open bins hold at its end (fewer than k pieces in each class) is joined and cut into
whole sequences and one of each power of two, without padding. No shuffle, one pass, memory of one open bin a
class.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scholium.llm import bpe
from scholium.llm import text as X
from scholium.llm.rows import TEXT

CAPACITY = 4096
LEAST = 256
END = 2
_lower: np.ndarray | None = None


def lower_table() -> np.ndarray:
    """Lower case of each code point by itself (the final sigma has no rule of its own); U+0130 is handled apart."""
    global _lower
    if _lower is None:
        out = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000:
                low = chr(c).lower()
                if len(low) == 1 and low != chr(c):
                    out[c] = ord(low)
        _lower = out
    return _lower


class WordEncoder:
    """Ids of whole texts by a vocabulary of words: NFC, lower case, white space dropped, merges with word ends."""

    def __init__(self, path: str, limit: int = 400_000):
        self.v = bpe.load(bpe.MergeVocabulary, path)
        self.cache = bpe.PieceCache(limit)

    @staticmethod
    def normalise(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Normalised code points, rows' offsets into them, UTF-8 bytes of them, start of each code point."""
        import unicodedata

        if not (data & 0x80).any():
            data = X.LOWER[data]
            return data.astype(np.uint32), offs, data, np.arange(len(data) + 1)
        whole = data.tobytes().decode("utf-8", "replace")
        if unicodedata.is_normalized("NFC", whole) and "İ" not in whole:
            cps = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
            ro = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), offs)
        else:
            raw = data.tobytes()
            each = [unicodedata.normalize("NFC", raw[a:b].decode("utf-8", "replace")).replace("İ", "i̇") for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            ro = np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)])
            cps = np.frombuffer("".join(each).encode("utf-32-le"), np.uint32)
        cps = lower_table()[cps]
        out = np.frombuffer(cps.tobytes().decode("utf-32-le").encode(), np.uint8)
        return cps, ro, out, np.append(np.flatnonzero((out & 0xC0) != 0x80), len(out))

    @staticmethod
    def bounds(cps: np.ndarray, ro: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words: contractions, runs of letters, single numbers, runs of others."""
        n = len(cps)
        cls = bpe.classes()[cps]
        row = np.zeros(n + 1, bool)
        row[ro[:-1]] = True
        begins = np.ones(n, bool)
        begins[1:] = (cls[1:] != cls[:-1]) | (cls[1:] == bpe.NUMBER)
        begins |= row[:n]
        q = np.flatnonzero((cps == 39) & begins)
        q = q[q + 1 < n]
        q = q[~row[q + 1] & (cls[q + 1] == bpe.LETTER)]
        nxt = cps[q + 1]
        far = np.minimum(q + 2, n - 1)
        two = np.where((q + 2 < n) & ~row[np.minimum(q + 2, n)], cps[far], 0)
        one = np.isin(nxt, [ord(c) for c in "stmd"])
        pair = ((nxt == ord("r")) & (two == ord("e"))) | ((nxt == ord("v")) & (two == ord("e"))) | ((nxt == ord("l")) & (two == ord("l")))
        for at, size in ((q[one], 2), (q[pair], 3)):
            begins[at + 1] = False
            end = at + size
            end = end[end < n]
            begins[end[~row[end] & (cls[end] == bpe.LETTER)]] = True
        s = np.flatnonzero(begins)
        e = np.append(s[1:], n)
        solid = cls[s] != bpe.BLANK
        return s[solid], e[solid]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, rows' offsets into them)."""
        cps, ro, raw, at = self.normalise(data, offs)
        if not len(cps):
            return np.empty(0, np.int32), np.zeros(len(offs), np.int64)
        cs, ce = self.bounds(cps, ro)
        s, e = at[cs], at[ce]
        h, first, inverse = np.unique(X.span(X.prefix(X.CODE[raw]), s, e), return_index=True, return_inverse=True)
        place = self.cache.lookup(h)
        new = np.flatnonzero(place < 0)
        if len(new):
            if len(self.cache.hashes) + len(new) > self.cache.limit and len(self.cache.hashes):
                self.cache.clear()
                new = np.arange(len(h))
            symbols = self.v.inner[raw]
            symbols[e - 1] = self.v.last[raw[e - 1]]
            flat, n = bpe.merge_spans(symbols, s[first[new]], (e - s)[first[new]], self.v.pairs)
            self.cache.add(h[new], flat, n, {})
            place = self.cache.lookup(h)
        place = place[inverse]
        n = np.diff(self.cache.offs)[place]
        ids = self.cache.ids[X.ragged(self.cache.offs[place], n)]
        ends = np.concatenate([[0], np.cumsum(n)])
        return ids, ends[np.searchsorted(cs, ro)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class Packer:
    """Bins of one task. ``emit(doc, start, ids, total, sequence, offset)`` gets every piece once."""

    def __init__(self, emit, first: int, capacity: int = CAPACITY, least: int = LEAST):
        self.emit, self.next, self.capacity, self.least = emit, first, capacity, least
        self.open: dict[int, list] = {}

    def _sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, doc, ids: np.ndarray) -> None:
        total, cap, at = len(ids), self.capacity, 0
        while total - at >= cap:
            self.emit(doc, at, ids[at : at + cap], total, self._sequence(), 0)
            at += cap
        size = cap >> 1
        while at < total:
            if size >= self.least:
                if total - at >= size:
                    self._put(doc, at, ids[at : at + size], total)
                    at += size
                size >>= 1
            else:
                self._put(doc, at, ids[at:], total)
                at = total

    def _put(self, doc, at: int, ids: np.ndarray, total: int) -> None:
        k = self.capacity // len(ids)
        bin_ = self.open.setdefault(k, [])
        bin_.append((doc, at, ids, total))
        if len(bin_) == k:
            sequence, offset = self._sequence(), 0
            for doc, at, ids, total in bin_:
                self.emit(doc, at, ids, total, sequence, offset)
                offset += len(ids)
            del self.open[k]

    def finish(self) -> None:
        """Joins what is left and cuts it into whole sequences and powers of two."""
        rest = [p for k in sorted(self.open) for p in self.open[k]]
        left = sum(len(p[2]) for p in rest)
        self.open = {}
        room = offset = sequence = 0
        for doc, at, ids, total in rest:
            while len(ids):
                if not room:
                    room, sequence, offset = min(self.capacity, 1 << (left.bit_length() - 1)), self._sequence(), 0
                take = min(room, len(ids))
                self.emit(doc, at, ids[:take], total, sequence, offset)
                at, ids, offset, room, left = at + take, ids[take:], offset + take, room - take, left - take


def harmonic_pack(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", ids: str | None = None, capacity: int = CAPACITY, least: int = LEAST, end: int = END) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if ``ids`` names a column.

    ``path``: a tokenizers file of word merges, readable on every executor. ``capacity`` and ``least`` are powers of
    two. A null or empty text is the end id alone. Texts of any length are cut, never dropped; repeated rows and
    null ids are packed like others; an empty table gives an empty one; other columns of ``docs`` are not read.
    """
    if capacity & (capacity - 1) or least & (least - 1) or least > capacity:
        raise ValueError("capacity and least are powers of two, least not above capacity")
    chosen = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias(TEXT))
    long = T.LongType()
    out = T.StructType([chosen.schema["doc_id"]] + [T.StructField(n, long) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + ([T.StructField(ids, T.ArrayType(T.IntegerType(), False))] if ids else []))
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        rows: list[tuple] = []

        def emit(doc, start, piece, total, sequence, offset):
            rows.append((doc, start, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), total, sequence, offset, *([piece] if ids else [])))

        def batch():
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

        packer = Packer(emit, TaskContext.get().partitionId() << 33, capacity, least)
        for block, data, offs in X.blocks(batches, TEXT, X.BLOCK >> 2):
            flat, io = enc.encode(data, offs)
            io = io.tolist()
            for i, doc in enumerate(block.column("doc_id").to_pylist()):
                packer.add(doc, np.append(flat[io[i] : io[i + 1]], np.int32(end)))
            if rows:
                yield batch()
        packer.finish()
        if rows:
            yield batch()

    return chosen.mapInArrow(run, out)
