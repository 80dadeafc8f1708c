"""Removal of long repeated passages, by a compressed FM-index per shard.

A window of ``k`` consecutive words goes if its word sequence also starts in a document with a smaller id.

1. Routing: of the ``k // 5``-word grams of a window the least hash is its key, so equal windows have equal keys.
   Consecutive windows of one key form a segment. Keys that only one document has need no search: the least and
   greatest document of every key, aggregated before the shuffle, set a bit in a filter of fixed size for each key of
   at least two documents (a filter that is too full lets through more, never less).
2. Equal segments count once, with their least document. A key whose segments are all equal is settled by that: each of
   its windows begins in that document first. The segments of the other keys go to the shard of their key, each from its
   least document only (a filter of fixed size tells which these are; a full one sends some more), a block's in one piece
   with their words in a dictionary. Shards are as many as these words need.
3. Every shard builds an FM-index: Burrows-Wheeler transform of its segments in a wavelet matrix of packed bits with block
   counts. A symbol is a run of ``t`` words, the greatest divisor of k up to its root, and a segment is written ``t`` times,
   from its first, second, ... word on; a window is then k / t symbols that follow one another. Suffixes are ordered
   by as many symbols, ties by document: that is all that backward search of a window needs, and the first suffix of
   an interval is that of the least document.
4. The segments stream against the index: all windows step backwards in lockstep, and a window's matching statistic
   is how far it gets before its interval holds one suffix (its own). Those that reach k words are reported, as runs with
   their least documents, which go back to the documents.

A shard holds distinct segments only. A key that very many different segments share stays in one shard, which indexes
and searches it in pieces of ``INDEX`` words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scholium.llm import text as X
from scholium.llm.rows import TEXT
from scholium.llm.shared import materialize

K = 50
FILTER = 26
#: Windows of a segment at most, and words of an index at most.
SEGMENT = 256
INDEX = 2_000_000
#: Words of a shard, on average, and windows that step at once.
SHARD = 400_000
STEP = 1 << 17


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of x[i : i + n] for every i where that fits."""
    have, size = x, 1
    while 2 * size <= n:
        have = np.minimum(have[:-size], have[size:])
        size *= 2
    return np.minimum(have[: len(x) - n + 1], have[n - size :]) if n > size else have


def segments(w: np.ndarray, wo: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, first word (index into ``w``), number of windows and row of every segment."""
    at, wino = X.windows(wo, k)
    if not len(at):
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none
    g = max(1, k // 5)
    sums = X.prefix(w)
    start = np.arange(len(w) - g + 1)
    key = sliding_min(X.span(sums, start, start + g), k - g + 1)[at]
    row = X.row_of(wino)
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    first = np.flatnonzero(place % SEGMENT == 0)
    return key[first], at[first], np.diff(np.append(first, len(at))), row[first]


def _blocks(batches: Iterator[pa.RecordBatch]):
    for rows, data, offs in X.blocks(batches, TEXT):
        s, e, wo = X.words(data, offs)
        yield rows, X.word_hashes(data, s, e), wo


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _keys(docs: DataFrame, k: int) -> DataFrame:
    """(g, lo, hi): keys with their least and greatest document, aggregated for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, w, wo in _blocks(batches):
            g, _, _, row = segments(w, wo, k)
            doc = rows.column("id").to_numpy()[row]
            order = np.lexsort((doc, g))
            g, doc = g[order], doc[order]
            first = np.flatnonzero(np.diff(g, prepend=g[:1] + np.uint64(1)) != 0)
            last = np.append(first[1:], len(g))[: len(first)] - 1
            yield pa.RecordBatch.from_arrays([_signed(g[first]), pa.array(doc[first]), pa.array(doc[last])], names=["g", "lo", "hi"])

    return docs.mapInArrow(run, "g long, lo long, hi long").groupBy("g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")


def _filter(keys: DataFrame) -> np.ndarray:
    """Bits of the keys; of fixed size whatever the corpus."""
    words = keys.select(F.shiftrightunsigned("g", 64 - FILTER).alias("x")).groupBy(F.shiftright("x", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(x, 64) as int))")).alias("m"))
    out = np.zeros(1 << (FILTER - 6), np.int64)
    for r in words.toLocalIterator():
        out[r["w"]] = r["m"]
    return out.view(np.uint8)


def _wanted_segments(batches: Iterator[pa.RecordBatch], k: int, bits: np.ndarray):
    """Segments of wanted keys, block by block: rows, words, rows' offsets, keys, digests, first words, windows and rows."""
    for rows, w, wo in _blocks(batches):
        g, first, n, row = segments(w, wo, k)
        keep = _has(bits, g)
        g, first, n, row = g[keep], first[keep], n[keep], row[keep]
        digest = X.span(X.prefix(X.mix(w ^ X.CODE[210])), first, first + n + k - 1)
        yield rows, w, wo, g, digest, first, n, row


def _occurrences(docs: DataFrame, k: int, wanted) -> DataFrame:
    """(g, digest, id, th, at, n): segments of wanted keys, where they begin and their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, wo, g, digest, first, n, row in _wanted_segments(batches, k, wanted.value):
            pick = pa.array(row)
            yield pa.RecordBatch.from_arrays([_signed(g), _signed(digest), rows.column("id").take(pick), rows.column("th").take(pick), pa.array((first - wo[row]).astype(np.int64)), pa.array(n.astype(np.int32))], names=["g", "digest", "id", "th", "at", "n"])

    return docs.mapInArrow(run, "g long, digest long, id long, th long, at long, n int")


def _distinct(occ: DataFrame) -> DataFrame:
    """(g, digest, n, lo, hi, alone): segments with their least and greatest document, and whether their key has no other segment."""
    ends = occ.repartition("g").groupBy("g", "digest").agg(F.max("n").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    w = Window.partitionBy("g")
    return ends.withColumn("alone", F.min("digest").over(w) == F.max("digest").over(w))


def _sender(g: np.ndarray, digest: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Key of a segment in a document."""
    return X.mix(X.mix(g ^ digest * X.CODE[212]) + doc * X.CODE[213])


def _senders(ends: DataFrame) -> DataFrame:
    """(g): keys of the segments in their least documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_signed(_sender(*(batch.column(c).to_numpy().view(np.uint64) for c in ("g", "digest", "lo"))))], names=["g"])

    return ends.select("g", "digest", "lo").mapInArrow(run, "g long")


def _has(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    x = (key >> np.uint64(64 - FILTER)).astype(np.int64)
    return (bits[x >> 3] >> (x & 7).astype(np.uint8)) & 1 > 0


SEG = np.dtype([("g", "<i8"), ("digest", "<i8"), ("size", "<i8")])


def _bodies(docs: DataFrame, k: int, wanted, senders, shards: int) -> DataFrame:
    """(shard, segs, dictionary, codes): segments that their documents have to send, with their words; a row per block and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, w, _, g, digest, first, n, row in _wanted_segments(batches, k, wanted.value):
            on = _has(senders.value, _sender(g, digest, rows.column("id").to_numpy()[row].view(np.uint64)))
            g, digest, first, n = g[on], digest[on], first[on], n[on]
            shard = g.view(np.int64) % shards
            order = np.lexsort((digest, g, shard))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(g[order]) != 0) | (np.diff(digest[order]) != 0)
            order = order[new]
            size = n[order] + k - 1
            segs = np.empty(len(order), SEG)
            segs["g"], segs["digest"], segs["size"] = g[order].view(np.int64), digest[order].view(np.int64), size
            words = w[X.ragged(first[order], size)]
            ends = np.concatenate([[0], np.cumsum(size)])
            cut = [*np.flatnonzero(np.diff(shard[order], prepend=-1)).tolist(), len(order)]
            rows = []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                dictionary, codes = np.unique(words[ends[a] : ends[b]], return_inverse=True)
                rows.append((int(shard[order[a]]), segs[a:b].tobytes(), dictionary.tobytes(), codes.astype("<u2" if len(dictionary) <= 1 << 16 else "<u4").tobytes()))
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=["shard", "segs", "dictionary", "codes"])

    return docs.mapInArrow(run, "shard long, segs binary, dictionary binary, codes binary")


class FMIndex:
    """FM-index over symbol sequences (0 separates them), for patterns of up to ``depth`` symbols."""

    def __init__(self, symbols: np.ndarray, depth: int):
        n = len(symbols)
        rank, size = symbols.astype(np.int64), 1

        def wider(rank, by):
            after = np.zeros(n, np.int64)
            after[: max(0, n - by)] = rank[by:]
            return np.unique(rank * (int(rank.max(initial=0)) + 1) + after, return_inverse=True)[1]

        while 2 * size <= depth:
            rank = wider(rank, size)
            size *= 2
        if size < depth:
            rank = wider(rank, depth - size)
        self.suffixes = np.argsort(rank, kind="stable")
        bwt = symbols[self.suffixes - 1]
        sigma = int(symbols.max(initial=0)) + 2  # the greatest stands for symbols that the text lacks
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        self.levels = max(1, (sigma - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            one = (bwt >> level) & 1 > 0
            packed = np.packbits(np.append(one, np.zeros(64 + -n % 64, bool)), bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(n - int(one.sum()))
            bwt = np.concatenate([bwt[~one], bwt[one]])
        self.size = n

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol c among the first i of the transform."""
        low = np.zeros(len(c), np.int64)
        for level, (bits, counts, zeros) in enumerate(zip(self.bits, self.counts, self.zeros, strict=True)):
            one = (c >> (self.levels - 1 - level)) & 1 > 0

            def ones(at, bits=bits, counts=counts):
                word = at >> 6
                return counts[word] + np.bitwise_count(bits[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

            x, y = ones(low), ones(i)
            low, i = np.where(one, zeros + x, low - x), np.where(one, zeros + y, i - y)
        return i - low

    def search(self, text: np.ndarray, start: np.ndarray, depth: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of text[s : s + depth] for every start s.

        Gives the matching statistic of each, the number of its last symbols that at least ``least`` suffixes begin with,
        and the first rank of the interval that they make up.
        """
        matched, first = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        alive = np.arange(len(start))
        c = text[start + depth - 1]
        lo, hi = self.before[c], self.before[c + 1]
        for j in range(depth - 1, -1, -1):
            on = hi - lo >= least
            alive, lo, hi = alive[on], lo[on], hi[on]
            if not len(alive):
                break
            matched[alive], first[alive] = depth - j, lo
            if j:
                c = text[start[alive] + j - 1]
                lo, hi = self.before[c] + self.rank(c, lo), self.before[c] + self.rank(c, hi)
        return matched, first


def stride(k: int) -> int:
    """Words of a symbol: the greatest divisor of k up to its root."""
    return max(t for t in range(1, int(k**0.5) + 1) if k % t == 0)


def least_documents(words: np.ndarray, size: np.ndarray, doc: np.ndarray, k: int, limit: int = INDEX) -> np.ndarray:
    """For every window of every segment (``size`` words each, one behind another) the least document that has it, over all segments.

    Segments have at least k words each. Windows come in the order of segments and words.
    """
    t = stride(k)
    start = np.cumsum(size) - size
    order = np.argsort(doc, kind="stable")  # so that the first suffix of an interval is that of the least document
    own, m = doc[order], size[order] - t + 1
    # places of the symbols: of each segment those at words 0, t, 2t, ... and an end, then those at 1, t + 1, ... and an end
    # (arrays as long as the words are dropped as soon as they have served, and are of 32 bits where these suffice)
    small = np.int32 if int((m + t).sum()) < 2**31 else np.int64
    full = np.cumsum(m + t) - (m + t)
    row = np.repeat(np.arange(len(order), dtype=small), m)
    place = (np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)).astype(small)
    phase = place % t
    at = (full[row] + phase * (m // t + 1)[row] + np.minimum(phase, (m % t)[row]) + place // t).astype(small)
    del phase
    sums = X.prefix(X.mix(words ^ X.CODE[211]))
    first = start[order][row] + place
    symbol = X.span(sums, first, first + t)
    del sums, first
    symbol = np.unique(symbol, return_inverse=True)[1].astype(small)
    text = np.zeros(int((m + t).sum()), small)
    text[at] = symbol + 1
    del symbol
    windows = np.flatnonzero(place + k <= size[order][row])
    found = own[row[windows]]
    starts, depth = at[windows].astype(np.int64), k // t
    into = (np.cumsum(size - k + 1) - (size - k + 1))[order][row[windows]] + place[windows]
    del row, place, at
    piece = np.cumsum(m + t) // limit  # each is an index of its own, the segments stream against all of them
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(order)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        lo, hi = full[a], full[b - 1] + m[b - 1] + t
        dense, symbols = np.unique(text[lo:hi], return_inverse=True)
        index = FMIndex(symbols, depth)
        del symbols
        where = np.minimum(np.searchsorted(dense, text), len(dense) - 1).astype(small)
        query = np.where(dense[where] == text, where, small(len(dense)))
        del where
        owner = np.repeat(own[a:b], m[a:b] + t)
        for x in range(0, len(starts), STEP):
            matched, rank = index.search(query, starts[x : x + STEP], depth, 2 if len(cuts) == 2 else 1)
            hit = np.flatnonzero(matched == depth)
            found[hit + x] = np.minimum(found[hit + x], owner[index.suffixes[rank[hit]]])
    out = np.empty(len(windows), np.int64)
    out[into] = found
    return out


def _search(k: int):
    def run(table: pa.Table) -> pa.Table:
        """(g, digest, s, e, m): runs of windows of a segment that start in document m first, where m is not the last of the segment's documents."""
        X.give_back()
        bodies, ends = table.filter(pc.is_valid(table.column("segs"))), table.filter(pc.is_valid(table.column("lo")))
        lo, hi, g, digest = (ends.column(c).to_numpy() for c in ("lo", "hi", "g", "digest"))
        segs, words = [np.empty(0, SEG)], [np.empty(0, np.uint64)]
        for a, b, c in zip(*(bodies.column(c) for c in ("segs", "dictionary", "codes")), strict=True):
            dictionary = np.frombuffer(b.as_buffer(), np.uint64)
            segs.append(np.frombuffer(a.as_buffer(), SEG))
            words.append(dictionary[np.frombuffer(c.as_buffer(), "<u2" if len(dictionary) <= 1 << 16 else "<u4")])
        segs, words = np.concatenate(segs), np.concatenate(words)
        start = np.cumsum(segs["size"]) - segs["size"]
        # the segments of both sides, side by side; a full filter lets some through that are not asked for, and blocks may send the same
        both_g, both_digest = np.concatenate([segs["g"], g]), np.concatenate([segs["digest"], digest])
        side = np.repeat([0, 1], [len(segs), len(g)])
        by = np.lexsort((side, both_digest, both_g))
        x, y, side = both_g[by], both_digest[by], side[by]
        at = np.flatnonzero((x[1:] == x[:-1]) & (y[1:] == y[:-1]) & (side[1:] > side[:-1]))
        order, by = by[at], by[at + 1] - len(segs)
        if len(order) != len(g):
            raise ValueError("segments and their documents do not agree")
        lo, hi, g, digest = lo[by], hi[by], g[by], digest[by]
        size = segs["size"][order]
        m = least_documents(words[X.ragged(start[order], size)], size, lo, k) if len(order) else np.empty(0, np.int64)
        n = size - k + 1
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(m)) - np.repeat(np.cumsum(n) - n, n)
        first = np.flatnonzero((np.diff(m, prepend=-1) != 0) | (place == 0))
        end = np.diff(np.append(first, len(m))) + place[first]
        keep = m[first] < hi[row[first]]
        first, end = first[keep], end[keep]
        i = row[first]
        return pa.table({"g": pa.array(g[i]), "digest": pa.array(digest[i]), "s": pa.array(place[first]), "e": pa.array(end), "m": pa.array(m[first])})

    return run


def repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = K) -> DataFrame:
    """(id, th, start, end): word spans that windows of k words cover which a smaller document has too; th is xxhash64 of the text."""
    spark = docs.sparkSession
    body = F.col(f"`{text}`").cast("string")
    known = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.xxhash64(body).alias("th"), body.alias(TEXT)).where("id is not null")
    wanted = spark.sparkContext.broadcast(_filter(_keys(known, k)))
    occ = materialize(_occurrences(known, k, wanted), "occurrences")
    ends = materialize(_distinct(occ), "segments")
    several = ends.where(~F.col("alone"))
    words = several.agg(F.coalesce(F.sum(F.col("n") + (k - 1)), F.lit(0)).alias("n")).first()["n"]
    senders = spark.sparkContext.broadcast(_filter(_senders(several)))
    buckets = max(8, min(20_000, -(-words // SHARD)))
    # words go straight to their shard, beside the least and greatest document of each segment
    shards = _bodies(known, k, wanted, senders, buckets).unionByName(several.select(F.pmod("g", F.lit(buckets)).alias("shard"), "g", "digest", "lo", "hi"), allowMissingColumns=True)
    runs = materialize(shards.repartition(buckets, "shard").groupBy("shard").applyInArrow(_search(k), "g long, digest long, s long, e long, m long"), "runs")
    wanted.destroy()
    senders.destroy()
    runs = runs.unionByName(ends.where("alone and lo < hi").select("g", "digest", F.lit(0).cast("long").alias("s"), F.col("n").cast("long").alias("e"), F.col("lo").alias("m")))
    met = occ.join(runs, ["g", "digest"]).where("id > m")
    return met.select("id", "th", (F.col("at") + F.col("s")).alias("start"), (F.col("at") + F.col("e") + (k - 1)).alias("end"))


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = K, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_words, n_removed and kept (the words left, joined by a blank), a row per document.

    Words are runs of bytes other than ASCII white space. A null text has no words, and kept is empty. A row without an
    id loses nothing and is no source; rows that repeat an id are no sources for each other, and equal ones get equal
    results. Texts are read whole; an empty table gives an empty one; of a kept column that has the name of a
    result, the result stays.
    """
    spans = repeated_spans(docs, text, doc_id, k).groupBy("id", "th").agg(F.collect_list(F.struct("start", "end")).alias("__spans"))
    keep = [c for c in keep if c not in ("n_words", "n_removed", "kept")]
    body = F.col(f"`{text}`").cast("string")
    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], body.alias(TEXT), F.col(f"`{doc_id}`").cast("long").alias("__id"), F.xxhash64(body).alias("__th"))
    both = chosen.join(spans.select(F.col("id").alias("__id"), F.col("th").alias("__th"), "__spans"), ["__id", "__th"], "left")
    both = both.select(*[F.col(f"`{c}`") for c in keep], TEXT, F.col("__spans.start").alias("__starts"), F.col("__spans.end").alias("__ends"))
    out = T.StructType([chosen.schema[c] for c in keep] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in X.blocks(batches, TEXT):
            s, e, wo = X.words(data, offs)
            change = np.zeros(len(s) + 1, np.int64)
            a, b = rows.column("__starts"), rows.column("__ends")
            count = np.diff(a.offsets.to_numpy()) * a.is_valid().to_numpy(zero_copy_only=False)
            base = np.repeat(wo[:-1], count)
            np.add.at(change, a.flatten().to_numpy() + base, 1)
            np.add.at(change, b.flatten().to_numpy() + base, -1)
            gone = np.cumsum(change)[:-1] > 0
            left = ~gone
            ls, le = s[left], e[left]
            size = le - ls + 1
            lo = np.concatenate([[0], np.cumsum(left)])[wo]
            ends = np.concatenate([[0], np.cumsum(size)])
            at = X.ragged(ls, size)
            flat = np.append(data, np.uint8(32))[at] if len(at) else np.empty(0, np.uint8)
            flat[ends[1:] - 1] = 32
            raw = flat.tobytes()
            kept = [raw[x : max(x, y - 1)].decode() for x, y in zip(ends[lo[:-1]].tolist(), ends[lo[1:]].tolist(), strict=True)]
            columns = [rows.column(c).cast(arrow.field(c).type) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(wo)), pa.array(X.sums_by_row(gone, wo)), pa.array(kept, arrow.field("kept").type)], schema=arrow)

    return both.mapInArrow(run, out)


def substring_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = K) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of :func:`remove_repeats`."""
    return remove_repeats(docs, text, doc_id, k, (doc_id,)).select(doc_id, "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
