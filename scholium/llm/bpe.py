"""Byte-pair encoding in numpy: distinct pieces of text as length-bucketed padded matrices.

All rows of a matrix take one merge a round: the leftmost pair of the least rank, found by a row-wise argmin over
a matrix of pair ranks that is kept up to date (only the two pairs beside a merge are looked up again, in an
open-addressing hash table of pairs). After a merge the row moves up by one column, and rows without a pair left
leave the matrix. Only the distinct pieces of a block that no earlier block had are encoded.
"""

from __future__ import annotations

import base64
import json

import numpy as np

from scholium.llm import text as X

NONE = np.int32(2**31 - 1)


class PairTable:
    """(left, right) -> (rank, merged id): linear probing over a power-of-two table of at most half load."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        self.size = 1 << max(4, int(2 * len(left)).bit_length())
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.keys = np.full(self.size, 2**64 - 1, np.uint64)
        self.ranks = np.full(self.size, NONE, np.int32)
        self.merged = np.full(self.size, -1, np.int32)
        todo, at = np.arange(len(key)), self._slot(key)
        self.probes = 1
        while len(todo):  # of those that ask for the same free slot, the first takes it
            free = self.keys[at[todo]] == np.uint64(2**64 - 1)
            _, first = np.unique(at[todo[free]], return_index=True)
            won = todo[free][first]
            self.keys[at[won]], self.ranks[at[won]], self.merged[at[won]] = key[won], rank[won], merged[won]
            todo = np.setdiff1d(todo, won)
            at[todo] = (at[todo] + 1) & (self.size - 1)
            self.probes += bool(len(todo))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (X.mix(key) & np.uint64(self.size - 1)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of the pairs; -1 where there is no such pair."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self._slot(key)
        got = self.keys[at]
        out = np.where(got == key, at, -1)
        go = np.flatnonzero((got != key) & (got != np.uint64(2**64 - 1)))
        while len(go):
            at[go] = (at[go] + 1) & (self.size - 1)
            got = self.keys[at[go]]
            hit = got == key[go]
            out[go[hit]] = at[go[hit]]
            go = go[~hit & (got != np.uint64(2**64 - 1))]
        return out

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        slot = self.find(left, right)
        return np.where(slot >= 0, self.ranks[slot], NONE)


def merge_matrix(ids: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Fully merged ids of equally long rows: (flat ids, number of ids of each row)."""
    n, width = ids.shape
    lengths = np.full(n, width, np.int64)
    out = np.empty((n, width), np.int32)
    row = np.arange(n)
    ids = np.ascontiguousarray(ids, np.int32)
    ranks = pairs.rank_of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1) if width > 1 else np.empty((n, 0), np.int32)
    while len(row):
        w = ids.shape[1]
        if w > 1:
            at = ranks.argmin(axis=1)
            alive = ranks[np.arange(len(row)), at] != NONE
        else:
            at, alive = np.zeros(len(row), np.int64), np.zeros(len(row), bool)
        if not alive.all():
            done = ~alive
            out[row[done], :w] = ids[done]
            lengths[row[done]] = w
            row, ids, ranks, at = row[alive], ids[alive], ranks[alive], at[alive]
            if not len(row):
                break
        k = np.arange(len(row))
        new = pairs.merged[pairs.find(ids[k, at], ids[k, at + 1])]
        col = np.arange(w - 1)
        ids = np.where(col <= at[:, None], ids[:, :-1], ids[:, 1:])
        ids[k, at] = new
        ranks = np.where(col[:-1] < at[:, None], ranks[:, :-1], ranks[:, 1:])
        has = np.flatnonzero(at > 0)
        if len(has):
            ranks[has, at[has] - 1] = pairs.rank_of(ids[has, at[has] - 1], ids[has, at[has]])
        has = np.flatnonzero(at < w - 2)
        if len(has):
            ranks[has, at[has]] = pairs.rank_of(ids[has, at[has]], ids[has, at[has] + 1])
    return out[np.arange(width) < lengths[:, None]], lengths


def merge_long(ids: list[int], pairs: PairTable) -> list[int]:
    """One long row, by a heap over a linked list: the same merges in O(n log n)."""
    import heapq

    n = len(ids)
    ids, nxt, prv = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
    arr = np.array(ids, np.int64)
    slots = pairs.find(arr[:-1], arr[1:])
    known: dict[tuple[int, int], tuple[int, int] | None] = {}

    def look(a: int, b: int) -> tuple[int, int] | None:
        if (a, b) not in known:
            s = int(pairs.find(np.array([a]), np.array([b]))[0])
            known[a, b] = (int(pairs.ranks[s]), int(pairs.merged[s])) if s >= 0 else None
        return known[a, b]

    heap = [(int(pairs.ranks[s]), i, ids[i], ids[i + 1]) for i, s in enumerate(slots.tolist()) if s >= 0]
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i] if not gone[i] else n
        if j >= n or ids[i] != a or ids[j] != b:
            continue
        ids[i] = look(a, b)[1]
        gone[j] = 1
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            if got := look(ids[i], ids[nxt[i]]):
                heapq.heappush(heap, (got[0], i, ids[i], ids[nxt[i]]))
        if prv[i] >= 0 and (got := look(ids[prv[i]], ids[i])):
            heapq.heappush(heap, (got[0], prv[i], ids[prv[i]], ids[i]))
    return [x for x, g in zip(ids, gone, strict=True) if not g]


#: Rows longer than this go through the heap instead of a matrix.
LONG = 96
#: Cells of a matrix.
CELLS = 1 << 20


def merge_spans(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merged ids of spans of ``symbols``, in order: (flat ids, number of ids of each span)."""
    counts = np.zeros(len(starts), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order], prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
        width = int(lengths[order[a]])
        if width == 0:
            continue
        step = max(1, CELLS // width)
        for lo in range(a, b, step):
            some = order[lo : min(b, lo + step)]
            if width <= LONG:
                flat, n = merge_matrix(symbols[starts[some, None] + np.arange(width)], pairs)
            else:
                each = [merge_long(symbols[starts[i] : starts[i] + width].tolist(), pairs) for i in some]
                flat, n = np.array([x for e in each for x in e], np.int32), np.array([len(e) for e in each])
            counts[some] = n
            parts.append((some, n, flat))
    offs = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(offs[-1], np.int32)
    for some, n, flat in parts:
        out[X.ragged(offs[some], n)] = flat
    return out, counts


class PieceCache:
    """Ids of pieces seen before, by 64-bit hash; emptied when it would hold more than ``limit`` pieces."""

    def __init__(self, limit: int = 400_000):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.hashes, self.offs, self.ids, self.extra = np.empty(0, np.uint64), np.zeros(1, np.int64), np.empty(0, np.int32), {}

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of sorted distinct hashes, -1 where unknown."""
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == hashes, at, -1) if len(self.hashes) else np.full(len(hashes), -1)

    def add(self, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray, extra: dict[str, np.ndarray]) -> None:
        """New pieces; ``extra`` has further arrays with a value per piece."""
        lens = np.concatenate([np.diff(self.offs), counts])
        flat = np.concatenate([self.ids, ids])
        offs = np.concatenate([[0], np.cumsum(lens)])
        every = np.concatenate([self.hashes, hashes])
        order = np.argsort(every)
        self.hashes = every[order]
        self.ids = flat[X.ragged(offs[order], lens[order])]
        self.offs = np.concatenate([[0], np.cumsum(lens[order])])
        self.extra = {k: np.concatenate([self.extra[k], v])[order] if k in self.extra else v[order] for k, v in extra.items()}


# -- classes of code points ------------------------------------------------------------------------------------

SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]  # White_Space
OTHER_CLASS, LETTER, NUMBER, BLANK = 0, 1, 2, 3
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """Letter, number, white space or other for every code point."""
    global _classes
    if _classes is None:
        import regex

        every = "".join(map(chr, [*range(0xD800), *[0xFFFF] * 0x800, *range(0xE000, 0x110000)]))
        out = np.zeros(0x110000, np.uint8)
        for pattern, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
            for m in regex.finditer(pattern, every):
                out[m.start() : m.end()] = value
        out[SPACE] = BLANK
        _classes = out
    return _classes


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 bytes, and the byte each starts at (one more at the end)."""
    first = np.flatnonzero((data & 0xC0) != 0x80)
    if len(first) == len(data):
        cps = data.astype(np.uint32)
    else:
        cps = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return cps, np.append(first, len(data))


def piece_bounds(cps: np.ndarray, cls: np.ndarray, row_start: np.ndarray) -> np.ndarray:
    """Starts of the pieces that the pattern of the byte-level vocabularies cuts a text into; pieces have no gaps.

    Runs of one class are pieces; a run of letters, numbers or others takes one blank (U+0020) before it along;
    the rest of white space before a run is a piece of its own, and so is a last white-space character other than
    a blank; contractions ('s 't 're 've 'm 'll 'd) that start a match are pieces.
    """
    n = len(cps)
    if not n:
        return np.empty(0, np.int64)
    begins = np.zeros(n, bool)
    begins[0] = True
    begins[1:] = cls[1:] != cls[:-1]
    begins[row_start] = True
    head = begins.copy()  # of runs
    space = cls == BLANK
    # a run that follows white space of the same row: the last white-space character starts a piece; with a blank
    # there, the run itself does not
    after = np.flatnonzero(head & ~space)
    inner = np.ones(len(after), bool)
    rows = np.zeros(n + 1, bool)
    rows[row_start] = True
    inner &= (after > 0) & ~rows[after]
    after = after[inner]
    after = after[space[after - 1]]
    begins[after - 1] = True
    joined = after[cps[after - 1] == 32]
    begins[joined] = False
    # contractions: an apostrophe alone in its run that starts a match, letters right behind it
    quote = np.flatnonzero((cps == 39) & head & begins)
    if len(quote):
        quote = quote[quote + 1 < n]
        quote = quote[~rows[quote + 1] & (cls[quote + 1] == LETTER)]
        nxt = cps[quote + 1]
        # the letters behind may themselves have been cut nowhere, so both are in one run
        two = np.where(quote + 2 < n, cps[np.minimum(quote + 2, n - 1)], 0)
        two = np.where((quote + 2 < n) & ~rows[np.minimum(quote + 2, n)], two, 0)
        one = np.isin(nxt, [ord(c) for c in "stmd"])
        pair = ((nxt == ord("r")) & (two == ord("e"))) | ((nxt == ord("v")) & (two == ord("e"))) | ((nxt == ord("l")) & (two == ord("l")))
        for q, size in ((quote[one], 2), (quote[pair], 3)):
            begins[q + 1] = False
            end = q + size
            end = end[end < n]
            begins[end[(cls[end] == LETTER) & ~rows[end]]] = True
    return np.flatnonzero(begins)


# -- vocabularies ----------------------------------------------------------------------------------------------


class RankVocabulary:
    """A file of base64 tokens and ranks: ids are ranks, and any two neighbours whose bytes join to a token merge."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = np.empty(max(self.rank.values()) + 1, object)
        for token, r in self.rank.items():
            self.tokens[r] = token
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        found = [(self.rank[t[:i]], self.rank[t[i:]], r) for t, r in self.rank.items() for i in range(1, len(t)) if t[:i] in self.rank and t[i:] in self.rank]
        left, right, rank = (np.array(x, np.int64) for x in zip(*found, strict=True))
        self.pairs = PairTable(left, right, rank, rank)
        raw = np.frombuffer(b"".join(self.rank), np.uint8)
        ends = np.cumsum([len(t) for t in self.rank])
        h = X.span(X.prefix(X.CODE[raw]), ends - [len(t) for t in self.rank], ends)
        order = np.argsort(h)
        self.hashes, self.hashed = h[order], np.fromiter(self.rank.values(), np.int32)[order]

    def whole(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of pieces that are tokens themselves, -1 for others."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.hashed[at], -1)


class MergeVocabulary:
    """A tokenizers file of BPE merges with a suffix on the last symbol of a word, over byte characters."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        rest = [b for b in range(256) if b not in set(plain)]
        char = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.inner = np.array([vocab[char[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[char[b] + suffix] for b in range(256)], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, merged = (np.array([vocab[f(*m)] for m in merges], np.int64) for f in (lambda a, b: a, lambda a, b: b, lambda a, b: a + b))
        _, first = np.unique((left << 32) | right, return_index=True)
        rank = np.arange(len(merges))
        self.pairs = PairTable(left[first], right[first], rank[first], merged[first])


_loaded: dict = {}


def load(kind: type, path: str):
    """A vocabulary, read once a process."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]
