"""Jaccard join on word n-grams with rare-first prefix filtering.

1. Every document becomes its set of distinct n-grams (64-bit hashes). Documents with equal sets form a class
   (a 128-bit digest of the set); from here on a class counts once.
2. A sketch of fixed size (``2**bits`` counters, summed over all documents) gives an order of n-grams: rare first,
   ties by hash. Any order that all documents share gives exact results; the counts only make it a good one.
3. Two sets of Jaccard >= t share an n-gram within their first |x| - ceil(t |x|) + 1: only these prefixes are
   sent out, by n-gram, as (n-gram, class, size, position).
4. Classes that meet at an n-gram and pass the filters by length and position are not written out as pairs: each is
   put down beside a leader, the class of least digest that hangs together with it there. Any two that could link have a
   leader in common, so a leader's classes are a cluster, in which all pairs are looked at. From small clusters those
   classes go first that share too few n-grams of their prefixes with any other (the positional bound, by counts).
5. The sets go to their clusters. A large cluster is dealt into blocks and a task takes a pair of blocks, so neither a
   cluster nor its pairs are gathered anywhere. A task puts each pair through the filters (length, common n-grams of the
   prefixes and the positional bound that follows, suffix filter by counts between fixed pivots) and the rest to the
   exact test, once: a pair with several leaders in common is counted at the least of them.
6. What leaves a task is, for each class, the number of documents that it links to there and the least representative
   that it reaches there: no more rows than came in. Sums of the first are all links of a document; the second make
   edges whose components, by stars, are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.llm import text as X
from scholium.llm.components import components
from scholium.llm.rows import TEXT
from scholium.llm.shared import materialize, partitions_of, release

BITS = 24
PART = 1 << 16
#: Bits of the filter that says which classes are wanted; when it is too full it lets through more, never less.
WANTED = 24
#: Classes of an n-gram whose pairs are all put to the filters before they get a leader.
FEW = 16
#: A number of common n-grams that sets no bound.
UNKNOWN = 1 << 31
MET = np.dtype([("hub", "<u8"), ("d", "<u8"), ("n", "<u4"), ("c", "<u4")])
#: Classes of a block at least, and the sum of set sizes that a block is to have at most.
BLOCK_CLASSES = 256
BLOCK_GRAMS = 500_000
TILE = 256
ENTRY = np.dtype([("h", "<u8"), ("d", "<u8"), ("n", "<u4"), ("p", "<u4")])


def needed(nx, ny, percent: int):
    """Least overlap of sets of these sizes: percent * union <= 100 * overlap."""
    return -(-percent * (nx + ny) // (100 + percent))


def possible(nx, px, ny, py, percent: int):
    """Length and positional filter for an n-gram at places px and py."""
    enough = 100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)
    return enough & (np.minimum(px, py) + 1 + np.minimum(nx - px, ny - py) - 1 >= needed(nx, ny, percent))


def _by_row(rows: np.ndarray, n: int) -> np.ndarray:
    """A stable order by row; few rows sort as short numbers, in linear time."""
    return np.argsort(rows.astype(np.uint16) if n < 1 << 16 else rows, kind="stable")


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of every row, sorted within it, and the rows' offsets. Fewer than k words make one n-gram."""
    s, e, wo = X.words(data, offs)
    w = X.word_hashes(data, s, e)
    at, wino = X.windows(wo, k)
    h = np.zeros(len(at), np.uint64)
    for i in range(k):
        h += w[at + i] * X.CODE[i]
    h = X.mix(h)
    n = np.diff(wo)
    short = np.flatnonzero((n > 0) & (n < k))
    rows = X.row_of(wino)
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            has = n[short] > i
            own[has] += w[wo[short[has]] + i] * X.CODE[i]
        h = np.concatenate([h, X.mix(own ^ X.CODE[100 + n[short]])])
        rows = np.concatenate([rows, short])
    order = np.argsort(h)
    order = order[_by_row(rows[order], len(offs) - 1)]
    h, rows = h[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    h, rows = h[new], rows[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(offs) - 1))]).astype(np.int64)


def digests(h: np.ndarray, so: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, as two numbers."""
    def total(x):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)])
        return sums[so[1:]] - sums[so[:-1]]

    n = np.diff(so).astype(np.uint64)
    return X.mix(total(X.mix(h ^ X.CODE[200])) + n), X.mix(total(X.mix(h ^ X.CODE[201])) ^ n)


def slot(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _alone(d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """The first row of each class of a block, in the order of the rows."""
    order = np.lexsort((d2, d1))
    x, y = d1[order], d2[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return np.sort(order[new])


def _signatures(docs: DataFrame, k: int, bits: int) -> DataFrame:
    """Rows (id, n, d1, d2) for each document and, with ``bits``, rows (part, counts) of the sketch: classes, once a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits if bits else 0, np.uint16)
        none = lambda n, t: pa.nulls(n, t)
        names = ["id", "n", "d1", "d2", "part", "wide", "counts"]
        for rows, data, offs in X.blocks(batches, TEXT):
            h, so = shingle_sets(X.LOWER[data], offs, k)
            d1, d2 = digests(h, so)
            if bits:
                fresh = np.zeros(len(d1), bool)
                fresh[_alone(d1, d2)] = True
                at, n = np.unique(slot(h[np.repeat(fresh, np.diff(so))], bits), return_counts=True)
                counts[at] = np.minimum(counts[at] + n, 65535)
            m = rows.num_rows
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(np.diff(so)), _signed(d1), _signed(d2), none(m, pa.int32()), none(m, pa.int32()), none(m, pa.binary())], names=names)
        parts = [(i, *packed(counts[i * PART : (i + 1) * PART])) for i in range(-(-len(counts) // PART))]
        parts = [x for x in parts if x[2]]
        for at in range(0, len(parts), 64):
            some = parts[at : at + 64]
            m = len(some)
            yield pa.RecordBatch.from_arrays([*[none(m, pa.int64())] * 4, *[pa.array([x[i] for x in some], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))]], names=names)

    return docs.mapInArrow(run, "id long, n long, d1 long, d2 long, part int, wide int, counts binary")


def packed(counts: np.ndarray) -> tuple[int, bytes]:
    """Bytes of a count, and the counters of a part that are not zero: places in two bytes each, then the counts."""
    at = np.flatnonzero(counts)
    n = counts[at]
    wide = 1 if n.max(initial=0) < 256 else 2
    return wide, at.astype("<u2").tobytes() + n.astype(f"<u{wide}").tobytes()


def unpacked(blob: bytes, wide: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // (2 + wide)
    return np.frombuffer(blob, "<u2", n).astype(np.int64), np.frombuffer(blob, f"<u{wide}", n, 2 * n)


def _add_parts(table: pa.Table) -> pa.Table:
    """The sum of the counters of a part, as logarithms in 8 bits: 0 for none, 1 for one."""
    total = np.zeros(PART, np.uint64)
    for blob, wide in zip(table.column("counts"), table.column("wide").to_pylist(), strict=True):
        at, n = unpacked(blob.as_py(), wide)
        total[at] += n
    level = np.minimum(np.log2(np.maximum(total, 1)) * 6 + (total > 0), 255).astype(np.uint8)
    return pa.table({"part": table.column("part").slice(0, 1), "counts": pa.array([level.tobytes()], pa.binary())})


def _sketch(signatures: DataFrame, bits: int) -> np.ndarray:
    """Logarithms of the summed counters, in 8 bits: of fixed size whatever the corpus."""
    out = np.zeros(max(PART, 1 << bits), np.uint8)
    merged = signatures.where("part is not null").select("part", "wide", "counts").groupBy("part").applyInArrow(_add_parts, "part int, counts binary")
    for r in merged.toLocalIterator():
        out[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(r["counts"], np.uint8)
    return out[: 1 << bits]


def _rare_first(h: np.ndarray, so: np.ndarray, rare: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of every row, rare first, and what the sketch says of each."""
    q = rare[slot(h, bits)]
    order = np.argsort(q, kind="stable")  # the n-grams of a row come in order of their hashes
    order = order[_by_row(X.row_of(so)[order], len(so) - 1)]
    return h[order], q[order]


def prefix_length(n, percent: int):
    """N-grams of which two sets that link have one in common."""
    return n - -(-percent * n // 100) + (n > 0)


def _packed(key: str, target: np.ndarray, name: str, entries: np.ndarray) -> pa.Table:
    """A row a target: its number and its entries."""
    target = target.astype(np.int32)
    order = np.argsort(target, kind="stable")
    entries, target = np.ascontiguousarray(entries[order]), target[order]
    first = np.flatnonzero(np.diff(target, prepend=-1))
    ends = np.append(first, len(entries)) * entries.itemsize
    blobs = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(entries.view(np.uint8))])
    return pa.table({key: pa.array(target[first], pa.int32()), name: blobs.cast(pa.binary())})


def _prefixes(docs: DataFrame, k: int, percent: int, bits: int, sketch, buckets: int) -> DataFrame:
    """(bucket, entries): packed prefix entries, a row per block and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = sketch.value
        for _, data, offs in X.blocks(batches, TEXT, 4 * X.BLOCK):
            parts = []
            for lo, hi in X.slices(offs, X.BLOCK):
                d, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                h, so = shingle_sets(X.LOWER[d], o, k)
                d1, d2 = digests(h, so)
                h, _ = _rare_first(h, so, rare, bits)
                rows = _alone(d1, d2)
                n = np.diff(so)[rows]
                length = prefix_length(n, percent)
                pick = X.ragged(so[rows], length)
                entry = np.empty(len(pick), ENTRY)
                entry["h"], entry["d"], entry["n"] = h[pick], np.repeat(d1[rows], length), np.repeat(n, length)
                entry["p"] = pick - np.repeat(so[rows], length)
                parts.append(entry)
            every = np.concatenate(parts)
            if len(every):
                yield from _packed("bucket", every["h"] % np.uint64(buckets), "entries", every).to_batches()

    return docs.mapInArrow(run, "bucket int, entries binary")


def meetings(e: np.ndarray, percent: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For entries sorted by n-gram and class, each once: which of them meet another, the entry that leads each, and which share their n-gram with many.

    Two classes that share an n-gram and pass the filters have the same leader. Up to ``most`` classes of an n-gram, all
    pairs are put to the filters and what hangs together has one leader; of more, they are ordered by size and cut
    where the next is too long for the one before it, so that none on one side can link to one on the other.
    """
    m = len(e)
    start = np.flatnonzero(np.diff(e["h"], prepend=~e["h"][:1]) != 0) if m else np.empty(0, np.int64)
    count = np.diff(np.append(start, m))
    end = np.repeat(start + count, count)
    few = np.repeat(count <= most, count)
    n, p = e["n"].astype(np.int64), e["p"].astype(np.int64)
    lead, has, large = np.arange(m), np.zeros(m, bool), np.zeros(m, bool)
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    at = np.flatnonzero(few)
    for step in range(1, most):
        at = at[at + step < end[at]]
        to = at + step
        ok = possible(n[at], p[at], n[to], p[to], percent)
        left.append(at[ok])
        right.append(to[ok])
    x, y = np.concatenate(left), np.concatenate(right)
    has[x] = has[y] = True
    while len(x):
        least = np.minimum(lead[x], lead[y])
        if (lead[x] == least).all() and (lead[y] == least).all():
            break
        np.minimum.at(lead, x, least)
        np.minimum.at(lead, y, least)
    at = np.flatnonzero(~few)
    if len(at):
        group = np.repeat(start, count)[at]
        at = at[np.lexsort((n[at], group))]
        group = np.repeat(start, count)[at]
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (100 * n[at][:-1] < percent * n[at][1:])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        lead[at] = np.repeat(np.minimum.reduceat(at, first), size)
        has[at] = large[at] = np.repeat(size > 1, size)
    return has, lead, large


def _meet(percent: int, most: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """(to, met): every class of the bucket beside the leader of those that it meets, and at how many n-grams (UNKNOWN where many share one), packed by leader."""
        e = np.frombuffer(b"".join(x.as_py() for x in table.column("entries")), ENTRY)
        e = e[np.lexsort((e["d"], e["h"]))]
        new = np.ones(len(e), bool)
        new[1:] = (e["h"][1:] != e["h"][:-1]) | (e["d"][1:] != e["d"][:-1])
        e = e[new]  # several blocks may send the same class
        has, lead, large = meetings(e, percent, most)
        met = np.empty(int(has.sum()), MET)
        met["hub"], met["d"], met["n"], met["c"] = e["d"][lead[has]], e["d"][has], e["n"][has], np.where(large[has], UNKNOWN, 1)
        met = _summed(met)
        return _packed("to", X.mix(met["hub"]) % np.uint64(buckets), "met", met)

    return run


def _summed(met: np.ndarray) -> np.ndarray:
    """Each leader and class once, with the sum of their n-grams."""
    met = met[np.lexsort((met["d"], met["hub"]))]
    if not len(met):
        return met
    new = np.ones(len(met), bool)
    new[1:] = (met["hub"][1:] != met["hub"][:-1]) | (met["d"][1:] != met["d"][:-1])
    out = met[new]
    out["c"] = np.minimum(np.add.reduceat(met["c"].astype(np.int64), np.flatnonzero(new)), UNKNOWN)
    return out


def _every(table: pa.Table) -> pa.Table:
    """(hub, d, n, c) of the leaders that are gathered here."""
    met = _summed(np.frombuffer(b"".join(x.as_py() for x in table.column("met")), MET))
    return pa.table({"hub": _signed(met["hub"]), "d": _signed(met["d"]), "n": pa.array(met["n"].astype(np.int64)), "c": pa.array(met["c"].astype(np.int64))})


def _thin(percent: int, most: int):
    """Leaves out of small clusters the classes that share too few n-grams with all others there.

    ``total`` is the number of n-grams of its prefix at which a class meets any other, so two classes have at most the
    lesser total in common there; what lies behind the prefixes bounds the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _clusters(batches, ("hub",)):
            if table.num_rows <= most:
                n, total = table.column("n").to_numpy(), table.column("total").to_numpy()
                behind = n - prefix_length(n, percent)
                ok = np.minimum.outer(total, total) + np.maximum.outer(behind, behind) >= needed(n[:, None], n[None, :], percent)
                np.fill_diagonal(ok, False)
                table = table.filter(pa.array(ok.any(axis=1)))
            yield from table.select(["hub", "d", "n"]).to_batches()

    return run


def _wanted(met: DataFrame) -> np.ndarray:
    """Bits of a filter of fixed size that has every class that meets another."""
    words = met.select(F.shiftrightunsigned("d", 64 - WANTED).alias("x")).select(F.shiftright("x", 6).alias("w"), F.expr("shiftleft(1L, cast(pmod(x, 64) as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    out = np.zeros(1 << (WANTED - 6), np.int64)
    for r in words.toLocalIterator():
        out[r["w"]] = r["m"]
    return out.view(np.uint8)


def _sets(docs: DataFrame, k: int, percent: int, bits: int, sketch, wanted) -> DataFrame:
    """(d1, d2, q, grams) of the wanted classes, once a block: the grams rare first, and what the sketch says of the prefix's last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want, rare = wanted.value, sketch.value
        for _, data, offs in X.blocks(batches, TEXT):
            h, so = shingle_sets(X.LOWER[data], offs, k)
            d1, d2 = digests(h, so)
            x = slot(d1, WANTED)
            pick = _alone(d1, d2)
            pick = pick[((want[x >> 3] >> (x & 7).astype(np.uint8)) & 1 > 0)[pick] & (np.diff(so)[pick] > 0)]
            if len(pick):
                h, q = _rare_first(h, so, rare, bits)
                last = so[pick] + prefix_length(np.diff(so)[pick], percent) - 1
                grams = [h[so[i] : so[i + 1]].tobytes() for i in pick.tolist()]
                yield pa.RecordBatch.from_arrays([_signed(d1[pick]), _signed(d2[pick]), pa.array(q[last].astype(np.int32)), pa.array(grams, pa.binary())], names=["d1", "d2", "q", "grams"])

    return docs.mapInArrow(run, "d1 long, d2 long, q int, grams binary")


class Tile:
    """Some classes of a cluster, with what the filters need of them: sets rare first, order of the last n-gram of each prefix, earlier leaders."""

    def __init__(self, grams: list[np.ndarray], q: list[int], earlier: list[np.ndarray], percent: int):
        self.grams, self.earlier = grams, earlier
        self.n = np.array([len(g) for g in grams], np.int64)
        self.length = prefix_length(self.n, percent)
        self.heads = [g[:m] for g, m in zip(grams, self.length.tolist(), strict=True)]
        self.last = [(a, int(g[-1])) for a, g in zip(q, self.heads, strict=True)]
        row = np.repeat(np.arange(len(grams)), self.n)
        self.spread = np.bincount(row * 64 + (np.concatenate(grams) >> np.uint64(58)).astype(np.int64), minlength=64 * len(grams)).reshape(-1, 64)


NONE = np.empty(0, np.int64), np.empty(0, np.int64)


def linked(a: Tile, b: Tile | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a tile with another (None: with itself) that link; a pair is put to the exact test once."""
    o = a if b is None else b
    nx, ny = a.n[:, None], o.n[None, :]
    need = needed(nx, ny, percent)
    ok = np.minimum(nx, ny) >= need
    if b is None:
        ok &= np.arange(len(a.n))[:, None] < np.arange(len(a.n))[None, :]
    if any(map(len, a.earlier)) and any(map(len, o.earlier)):
        ok &= overlaps(a.earlier, o.earlier) == 0  # a pair with an earlier leader in common is counted there
    if not ok.any():
        return NONE
    shared = overlaps(a.heads, o.heads)
    ranks = {key: i for i, key in enumerate(sorted({*a.last, *o.last}))}
    wx, wy = np.array([ranks[k] for k in a.last])[:, None], np.array([ranks[k] for k in o.last])[None, :]
    # a common n-gram up to the earlier of both prefixes' ends is in both prefixes; what lies behind it bounds the rest
    behind = np.where(wx <= wy, nx - a.length[:, None], ny - o.length[None, :])
    x, y = np.nonzero(ok & (shared > 0) & (shared + behind >= need))
    step = 1 << 13
    near = [np.minimum(a.spread[x[i : i + step]], o.spread[y[i : i + step]]).sum(1) for i in range(0, len(x), step)]
    if not near:
        return NONE
    near = np.concatenate(near) >= need[x, y]
    x, y = x[near], y[near]
    if not len(x):
        return NONE
    rows, xi = np.unique(x, return_inverse=True)
    columns, yi = np.unique(y, return_inverse=True)
    exact = overlaps([a.grams[i] for i in rows.tolist()], [o.grams[j] for j in columns.tolist()])[xi, yi]
    on = exact >= need[x, y]
    return x[on], y[on]


def overlaps(x: list[np.ndarray], y: list[np.ndarray], wide: int = 1 << 16) -> np.ndarray:
    """Sizes of the intersections of all sets of x with all of y, by products of their incidence, long sets by ranges of hashes."""
    flat = np.concatenate(x + y)
    row = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in x + y])
    order = np.argsort(flat)
    flat, row = flat[order], row[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    first = np.flatnonzero(new)
    alone = np.diff(np.append(first, len(flat))) == 1
    column = np.cumsum(new) - 1
    on = ~alone[column]
    row, column = row[on], (np.cumsum(~alone) - 1)[column[on]]
    out = np.zeros((len(x), len(y)), np.float32)
    cuts = [0, *np.searchsorted(column, np.arange(wide, int(column.max(initial=0)) + 1, wide)).tolist(), len(column)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if lo < hi:
            c = column[lo:hi] - column[lo]
            m = np.zeros((len(x) + len(y), int(c[-1]) + 1), np.float32)
            m[row[lo:hi], c] = 1
            out += m[: len(x)] @ m[len(x) :].T
    return out.astype(np.int64)


def _clusters(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, of rows sorted by them."""
    held, before = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy() for c in keys], axis=1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and tuple(k[lo]) != before:
                yield pa.Table.from_batches(held)
                held = []
            before = tuple(k[lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


LINK = ("d1", "d2", "rep", "size")
PAIRS = ", ".join(f"{c}_{side} long" for side in "ab" for c in LINK)
SUMS = "d1 long, d2 long, rep long, links long, root long"


def _cluster_links(table: pa.Table, percent: int, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a pair of blocks that link."""
    own, hub, i = table.column("own").to_numpy(), table.column("hub")[0].as_py(), table.column("i")[0].as_py()
    grams = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("grams")]
    earlier = [np.array([h for h in hubs if h < hub], np.int64) for hubs in table.column("hubs").to_pylist()]
    q = table.column("q").to_pylist()

    def tiles(rows: np.ndarray) -> list[tuple[np.ndarray, Tile]]:
        cut = [rows[at : at + tile] for at in range(0, len(rows), tile)]
        return [(part, Tile([grams[r] for r in part], [q[r] for r in part], [earlier[r] for r in part], percent)) for part in cut]

    first = tiles(np.flatnonzero(own == i))
    found = []
    if table.column("j")[0].as_py() == i:
        todo = [(first[x], first[y] if y > x else None) for x in range(len(first)) for y in range(x, len(first))]
    else:
        second = tiles(np.flatnonzero(own != i))
        todo = [(x, y) for x in first for y in second]
    for (rows, a), other in todo:
        x, y = linked(a, other and other[1], percent)
        found.append((rows[x], (other[0] if other else rows)[y]))
    return np.concatenate([x for x, _ in found] or [NONE[0]]), np.concatenate([y for _, y in found] or [NONE[0]])


def _verify(percent: int, pairs: bool, tile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _clusters(batches, ("hub", "i", "j")):
            x, y = _cluster_links(table, percent, tile)
            if not len(x):
                continue
            if pairs:
                columns = {f"{c}_{side}": table.column(c).take(pa.array(at)).combine_chunks() for side, at in (("a", x), ("b", y)) for c in LINK}
            else:
                size, rep = table.column("size").to_numpy(), table.column("rep").to_numpy()
                links = np.zeros(len(size), np.int64)
                np.add.at(links, x, size[y])
                np.add.at(links, y, size[x])
                root = rep.copy()
                while True:
                    least = np.minimum(root[x], root[y])
                    if (root[x] == least).all() and (root[y] == least).all():
                        break
                    np.minimum.at(root, x, least)
                    np.minimum.at(root, y, least)
                on = pa.array(np.flatnonzero(links))
                columns = {c: table.column(c).take(on).combine_chunks() for c in ("d1", "d2", "rep")} | {"links": pa.array(links).take(on), "root": pa.array(root).take(on)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
        X.give_back()

    return run


def _join(known: DataFrame, k: int, percent: int, bits: int, pairs: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, n, d1, d2), classes (d1, d2, rep, size), and what :func:`_verify` says of the links between different classes."""
    spark = known.sparkSession
    buckets = max(8, min(20_000, 2 * partitions_of(known)))
    both = materialize(_signatures(known, k, bits), "signatures")
    rows = both.where("part is null").select("id", "n", "d1", "d2")
    sketch = spark.sparkContext.broadcast(_sketch(both, bits))
    classes = materialize(rows.where("n > 0").groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("size")), "classes")
    met = _prefixes(known, k, percent, bits, sketch, buckets).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_meet(percent, FEW, buckets), "to int, met binary")
    every = materialize(met.repartition(buckets, "to").groupBy("to").applyInArrow(_every, "hub long, d long, n long, c long"), "every")
    met = every.join(every.groupBy("d").agg(F.sum("c").alias("total")), "d").select("hub", "d", "n", "total")
    met = materialize(met.repartition("hub").sortWithinPartitions("hub").mapInArrow(_thin(percent, FEW), "hub long, d long, n long"), "met")
    release(every)
    wanted = spark.sparkContext.broadcast(_wanted(met))
    parts = F.greatest(F.ceil(F.count("*") / F.greatest(F.lit(BLOCK_CLASSES), 4 * F.sqrt(F.count("*")))), F.ceil(F.sum("n") / BLOCK_GRAMS))
    large = met.groupBy("hub").agg(parts.alias("parts")).where("parts > 1")
    of = met.join(large, "hub", "left").groupBy(F.col("d").alias("d1")).agg(F.collect_list(F.struct("hub", F.coalesce("parts", F.lit(1)).alias("parts"))).alias("to"))
    sets = _sets(known, k, percent, bits, sketch, wanted).dropDuplicates(["d1", "d2"]).join(classes.join(of, "d1"), ["d1", "d2"])
    dealt = sets.select(*LINK, "q", F.col("to.hub").alias("hubs"), "grams", F.explode("to").alias("t"))
    dealt = dealt.select(*LINK, "q", "hubs", "grams", "t.hub", F.col("t.parts").alias("parts")).withColumn("own", F.pmod(F.xxhash64("d1", "d2"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select(*LINK, "q", "hubs", "grams", "hub", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    checked = dealt.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j").mapInArrow(_verify(percent, pairs, TILE), PAIRS if pairs else SUMS)
    links = materialize(checked, "links")
    release(met)
    sketch.destroy()
    wanted.destroy()
    return rows, classes, links


def _members(rows: DataFrame, classes: DataFrame, more: DataFrame) -> DataFrame:
    """Documents with their class, the number of other documents that they link to, and further columns of ``more`` by class."""
    extra = [c for c in more.columns if c not in ("d1", "d2", "links")]
    counted = classes.join(more, ["d1", "d2"], "left").select("d1", "d2", "rep", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links"), *extra)
    return rows.join(counted, ["d1", "d2"], "left").withColumn("links", F.coalesce("links", F.lit(0)).cast("long"))


def ngram_jaccard_links(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 5, percent: int = 75, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """All links of :func:`ngram_jaccard_join`, written through classes of documents with equal sets of n-grams.

    The first table has a row per document with an id: doc_id, n_shingles, class_1, class_2 (which together name its class;
    null without words) and n_links, the number of other documents that it links to. The second has a row for each two
    classes that link: a_1, a_2, b_1, b_2, as many as there are. Two documents link if they share a class or their classes are in a row.
    """
    known = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias(TEXT)).where("id is not null")
    rows, classes, links = _join(known, k, percent, bits, pairs=True)
    ends = links.select("d1_a", "d2_a", "size_b").union(links.select("d1_b", "d2_b", "size_a")).toDF("d1", "d2", "other")
    found = _members(rows, classes, ends.groupBy("d1", "d2").agg(F.sum("other").alias("links")))
    has = F.col("n") > 0
    members = found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(has, F.col("d1")).alias("class_1"), F.when(has, F.col("d2")).alias("class_2"), F.col("links").alias("n_links"))
    return members, links.select("d1_a", "d2_a", "d1_b", "d2_b").toDF("a_1", "a_2", "b_1", "b_2")


def ngram_jaccard_join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 5, percent: int = 75, bits: int = BITS) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (the smallest doc_id that it reaches by links) and n_links (documents that it links to).

    Two documents link when percent * |union| <= 100 * |intersection| of their sets of k-word n-grams (words are
    runs of bytes other than ASCII white space, A-Z in lower case); a text of fewer words is one n-gram. Documents
    without words have n_shingles 0 and link to nothing, not even to each other. A row without an id links to
    nothing and has no component. Rows that repeat are in one component, each a link of the others; an empty table gives
    an empty one; other columns are not read. The links themselves are :func:`ngram_jaccard_links`.
    """
    chosen = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias(TEXT))
    rows, classes, links = _join(chosen.where("id is not null"), k, percent, bits)
    roots = components(links.select("rep", "root").where("rep <> root"), "rep", "root").withColumnRenamed("root", "component")
    found = _members(rows, classes, links.groupBy("d1", "d2").agg(F.sum("links").alias("links")))
    out = found.join(roots, found.rep == roots.node, "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id"), F.col("links").alias("n_links"))
    without = _signatures(chosen.where("id is null"), k, 0).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(without)
