"""Byte-level BPE encoding and decoding of whole texts.

A text is cut into pieces by the vocabulary's pattern (vectorised over code-point classes), the distinct pieces of
a block that the worker has not met are merged as matrices (:mod:`scholium.llm.bpe`), and the ids of a text are
the ids of its pieces in order. Decoding maps ids to their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from scholium.llm import bpe
from scholium.llm import text as X
from scholium.llm.rows import map_rows

FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


class Encoder:
    """Encodes blocks of rows; remembers up to ``limit`` pieces between blocks."""

    def __init__(self, path: str, limit: int = 400_000):
        self.v = bpe.load(bpe.RankVocabulary, path)
        self.cache = bpe.PieceCache(limit)

    def pieces(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each piece of the block its place in the cache, and the rows' offsets into the pieces."""
        cps, at = bpe.code_points(data)
        start = at[:-1]
        rows = np.searchsorted(start, offs[:-1][offs[:-1] < offs[1:]])
        s = start[bpe.piece_bounds(cps, bpe.classes()[cps], rows)]
        e = np.append(s[1:], len(data)) if len(s) else s
        h, first, inverse = np.unique(X.span(X.prefix(X.CODE[data]), s, e), return_index=True, return_inverse=True)
        place = self.cache.lookup(h)
        new = np.flatnonzero(place < 0)
        if len(new):
            if len(self.cache.hashes) + len(new) > self.cache.limit and len(self.cache.hashes):
                self.cache.clear()
                new = np.arange(len(h))
            self._add(h[new], s[first[new]], e[first[new]] - s[first[new]], data)
            place = self.cache.lookup(h)
        return place[inverse], np.searchsorted(s, offs)

    def _add(self, h: np.ndarray, s: np.ndarray, size: np.ndarray, data: np.ndarray) -> None:
        whole = self.v.whole(h)
        rest = np.flatnonzero(whole < 0)
        flat, n = bpe.merge_spans(self.v.single[data], s[rest], size[rest], self.v.pairs)
        counts = np.ones(len(h), np.int64)
        counts[rest] = n
        offs = np.concatenate([[0], np.cumsum(counts)])
        ids = np.empty(offs[-1], np.int32)
        known = np.flatnonzero(whole >= 0)
        ids[offs[known]] = whole[known]
        ids[X.ragged(offs[rest], n)] = flat
        every, bounds = ids.tolist(), offs.tolist()
        said = np.empty(len(h), object)
        said[:] = [" ".join(map(str, every[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.cache.add(h, ids, counts, {"said": said})

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, rows' offsets into them, places of the pieces, rows' offsets into those)."""
        place, po = self.pieces(data, offs)
        c = self.cache
        n = np.diff(c.offs)[place]
        ids = c.ids[X.ragged(c.offs[place], n)]
        ends = np.concatenate([[0], np.cumsum(n)])
        return ids, ends[po], place, po


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder: what one task has learnt of pieces serves the worker's next."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def decode(ids: np.ndarray, tokens: np.ndarray) -> bytes:
    """The bytes that a sequence of ids stands for."""
    return b"".join(tokens[ids].tolist())


def with_byte_bpe(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: str | None = None) -> DataFrame:
    """``keep`` columns, ``n_tokens``, the digests of the ids and of the decoded bytes, and the ids if ``ids`` names a column.

    ``path``: a rank file, readable on every executor (part of the Python environment). Null or empty texts have
    no ids: 0 and the digests of the empty string. Repeated rows give repeated results; an empty table gives an
    empty one; of a kept column that has the name of a result, the result stays. Long pieces (over 96 bytes) are
    merged one by one in O(n log n), with the same merges.
    """
    fields = FIELDS + ([T.StructField(ids, T.ArrayType(T.IntegerType(), False))] if ids else [])

    def start() -> Callable:
        enc = encoder(path)

        def block(data, offs, valid):
            flat, io, place, po = enc.encode(data, offs)
            said, tokens = enc.cache.extra.get("said", np.empty(0, object)), enc.v.tokens
            a, d = [], []
            for p, q, i, j in zip(po[:-1].tolist(), po[1:].tolist(), io[:-1].tolist(), io[1:].tolist(), strict=True):
                a.append(hashlib.sha256(" ".join(said[place[p:q]].tolist()).encode()).hexdigest())
                d.append(hashlib.sha256(decode(flat[i:j], tokens)).hexdigest())
            more = [pa.ListArray.from_arrays(pa.array(io, pa.int32()), pa.array(flat, pa.int32()))] if ids else []
            return [np.diff(io), a, d, *more]

        return block

    return map_rows(docs, start, fields, text, keep)
