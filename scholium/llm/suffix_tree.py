"""Language-model scores by a probabilistic suffix tree over words.

The root predicts a word by its smoothed share of the training tokens. A node of depth n is a context of n words; it
is kept if it was seen ``LEAST`` times, its suffix was kept (the tree grows from the root), and it passes a divergence
test: sum over its next words of c ln(P'(w | context) / P(w | suffix)), with every occurrence left out of its own estimate,
must exceed ``GAIN``. Next-word distributions are smoothed towards the suffix's: (c + ALPHA P(w | suffix)) / (N + ALPHA).
A token is scored in the state of the longest kept suffix of the words before it. Levels are built one behind another
until no context of a level is kept (or to a ``depth`` that the caller gives).

All counts are over all training rows and grow with the corpus. Texts are read once: a block of rows is written as its
distinct words and a number a token. For each level a block asks once for each distinct gram whose context can be kept: it
sends packed, to the task of the context, how often it has the gram in training rows and the gram's probability behind the
suffix, which it knows from the level before. The task sums, puts its contexts to the test and answers each block in the
order of its question with counts alone, from which the block has the probabilities of its tokens. So a token is scored while the
tree grows, what moves is a row a block and task, and neither texts nor a table of all weights are joined. What a block knows
is worked out anew from its answers; from the second level on only tokens behind kept contexts are left, and this is written.

Words and contexts stand as 64-bit hashes; words behind a context as numbers that the tasks of the first level have given them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scholium.llm import text as X
from scholium.llm.rows import TEXT
from scholium.llm.shared import materialize, partitions_of, release

LEAST = 8
GAIN = 2.0
ALPHA = 10.0
END = np.uint64(0x5EED0E2D)
FIRST = 0.1  # added to every count of the root
SETTLE = 2  # the level behind which blocks are written anew


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of each row and one end behind them; rows' offsets. Bytes are hashed some rows at a time."""
    parts, ends = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)]
    for lo, hi in X.slices(offs, X.BLOCK >> 2):
        low = X.LOWER[data[offs[lo] : offs[hi]]]
        s, e, wo = X.words(low, offs[lo : hi + 1] - offs[lo])
        out = np.full(len(s) + hi - lo, END, np.uint64)
        out[np.arange(len(s)) + X.row_of(wo)] = X.word_hashes(low, s, e)
        ends.append((wo + np.arange(len(wo)))[1:] + ends[-1][-1])
        parts.append(out)
    return np.concatenate(parts), np.concatenate(ends)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Key of the word or gram ``b`` behind ``a``."""
    return X.mix(X.mix(a ^ X.CODE[220]) + b * X.CODE[221])


def _packed(x: np.ndarray) -> bytes:
    """The numbers compressed, their lowest bytes first, then the next: small numbers and frequent ones take little."""
    if not len(x):
        return b""
    raw = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T)
    return raw.size.to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _opened(blob: bytes, kind: str) -> np.ndarray:
    if not len(blob):
        return np.empty(0, kind)
    raw = pa.decompress(pa.py_buffer(blob)[8:], int.from_bytes(blob[:8], "little"), codec="zstd")
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _first(x: np.ndarray) -> np.ndarray:
    """Where the sorted column changes."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return np.flatnonzero(new)


def _part(key: np.ndarray, parts: int | np.ndarray) -> np.ndarray:
    """Tasks hold ranges of keys, so keys in order are in order of task."""
    return ((key >> np.uint64(32)) * np.asarray(parts, np.uint64) >> np.uint64(32)).astype(np.int64)


def _tasks(uses: np.ndarray, n: int, parts: int) -> np.ndarray:
    """Over how many tasks the grams behind a word go: no task has more tokens of one word than a task has on average."""
    return np.clip(-(-uses * parts // max(1, n)), 1, parts)


ASKED = "part int, block long, ctx binary, runs binary, n binary, word binary, c binary, up binary"
TOLD = "block long, level int, part int, n binary, gains binary, c binary, total long, kept long"
_ASKED, _TOLD = (pa.schema([(c, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t]) for c, t in (x.split() for x in s.split(", "))]) for s in (ASKED, TOLD))
HEAVY = ("ids", "known", "base", "score")  # what questions do not need


def _blocks(docs: DataFrame) -> DataFrame:
    """Rows in blocks: ids, folds, offsets (to), distinct words (keys, the most frequent first), the number of each token's word.

    ``depth`` levels are settled in ``score``; ``at`` and ``p``: the tokens that are not, and their probability so far.
    """
    out = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema["doc_id"].dataType)), *[T.StructField(c, T.BinaryType()) for c in ("held", "to", "keys", "word", "at", "p", "known", "base", "score")], T.StructField("depth", T.IntegerType())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for rows, data, offs in X.blocks(batches, TEXT, 2 * X.BLOCK):
            w, to = tokens(data, offs)
            keys, word = np.unique(w, return_inverse=True)
            order = np.argsort(-np.bincount(word, minlength=len(keys)), kind="stable")
            rank = np.empty(len(keys), "<u4")
            rank[order] = np.arange(len(keys))
            ids = rows.column("doc_id")
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            held = rows.column("held_out").to_numpy(zero_copy_only=False).astype(np.uint8)
            own = [held.tobytes(), _packed(to.astype("<i8")), keys[order].tobytes(), _packed(rank[word]), None, None, None, None, None]
            yield pa.RecordBatch.from_arrays([pa.array([block]), ids.cast(arrow.field("ids").type), *[pa.array([x], pa.binary()) for x in own], pa.array([0], pa.int32())], schema=arrow)
            block += 1

    return docs.mapInArrow(run, out)


class _Block:
    """A block's tokens, followed through the levels that it has answers for: ``at`` are those that go into level ``level``, ``p``
    their probability so far, ``score`` the sum of the logarithms of the others."""

    def __init__(self, own: dict, answers: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], n: int, v: int, alpha: float, least: int, gain: float, parts: int):
        self.n, self.parts = n, parts
        self.word, self.to = _opened(own["word"], "<u4"), _opened(own["to"], "<i8")
        self.row = X.row_of(self.to)
        self.held = np.frombuffer(own["held"], np.uint8)
        self.place = np.arange(len(self.word)) - np.repeat(self.to[:-1], np.diff(self.to))
        m = len(self.held)
        self.uses = self.pairs = None
        if own["depth"]:
            self.at, self.p = _opened(own["at"], "<i8"), _opened(own["p"], "<f8")
            self.keys = self.names = _opened(own["keys"], "<u8")
            self.known, self.base, self.score = (np.frombuffer(own[c], "<f8").copy() if own.get(c) else np.zeros(m) for c in ("known", "base", "score"))
        else:
            self.keys, rank = _in_order(own["keys"])
            self.names, self.uses = answers[0][0].view(np.uint64), answers[0][2]
            self.named = self.names[rank]
            self.word = rank[self.word]
            p = (self.uses + FIRST) / (n + FIRST * (v + 1))
            self.at, self.p = np.arange(len(self.word)), p[self.word]
            self.known, self.base, self.score = np.bincount(self.row, (self.uses > 0)[self.word], m), np.bincount(self.row, np.log10(p)[self.word], m), np.zeros(m)
        self.level = own["depth"] + 1
        self._narrow(least)
        while self.level in answers:
            entry, _, of, runs, _, _ = self.entries()
            count, gains, c = answers[self.level]
            total = np.zeros(int(runs.max(initial=-1)) + 1, np.int64)
            if self.level == 1:
                # of a context of many tasks each told its share of the sum that is tested
                uses = self.uses[self.word[self.at - 1]]
                total[of[entry]] = uses
                many = _tasks(total, n, parts) > 1
                alone = np.bincount(runs[many[runs]], gains, len(total))
                total[many & ~((total >= least) & (alone > gain))] = 0
                one = ~many[runs]
                total[runs[one]] = count[one]
            else:
                total[runs] = count
            total = total[of[entry]]
            c = c[entry]
            if self.level == 1:
                self.pairs = np.zeros(len(self.word), np.int64)
                self.pairs[self.at] = c
            kept = total > 0
            self._settle(kept)
            self.p = (c[kept] + alpha * self.p) / (total[kept] + alpha)
            self.level += 1
            self._narrow(least)

    def _settle(self, on: np.ndarray) -> None:
        """Goes on with the chosen tokens; the others have their probability."""
        self.score += np.bincount(self.row[self.at[~on]], np.log10(self.p[~on]), len(self.score))
        self.at, self.p = self.at[on], self.p[on]

    def _narrow(self, least: int) -> None:
        """Leaves tokens with enough words before them; of a context of one or two words the count is known already."""
        on = self.place[self.at] >= self.level
        if self.level == 1:
            on &= (self.uses >= least)[self.word[self.at - 1]]
        elif self.level == 2 and self.pairs is not None:
            on &= self.pairs[self.at - 1] >= least
        self._settle(on)

    def entries(self) -> tuple[np.ndarray, ...]:
        """Number of each token's gram; of each gram a token and the number of its context; of each run of grams the number of the
        context, the task and the length. Grams and runs are in order of task and context; a run may be empty."""
        at = self.at
        if self.level == 1:
            bits, low = max(1, (len(self.keys) - 1).bit_length()), max(1, len(at).bit_length())
            code = (self.word[at - 1].astype(np.uint64) << np.uint64(bits)) | self.word[at]
            if 2 * bits + low <= 64:
                code = (code << np.uint64(low)) | np.arange(len(at), dtype=np.uint64)
                code.sort()
                order = (code & np.uint64((1 << low) - 1)).astype(np.int64)
                code >>= np.uint64(low)
            else:
                order = np.argsort(code)
                code = code[order]
            first = _first(code)
            ctx = self.word[at[order[first]] - 1]
            new = _first(ctx)
            of = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(ctx))))
            # a context of many tasks asks all of them, so that each block sees their whole sum
            tasks = _tasks(self.uses[ctx[new]], self.n, self.parts)
            start = np.cumsum(tasks) - tasks
            runs = np.repeat(np.arange(len(new)), tasks)
            part = ((_part(self.keys[ctx[new]], self.parts) - start)[runs] + np.arange(len(runs))) % self.parts
            run = start[of] + _part(self.keys[self.word[at[order[first]]]], tasks[of])
            length = np.bincount(run, minlength=len(runs))
            by, by_run = (np.argsort(x.astype(np.uint16), kind="stable") for x in (part[run], part))
            of, runs, part, length = of[by], runs[by_run], part[by_run], length[by_run]
        else:
            ctx = self.keys[self.word[at - self.level]]
            for i in range(self.level - 1, 0, -1):
                ctx = pair(ctx, self.keys[self.word[at - i]])
            code = pair(ctx, self.keys[self.word[at]])
            order = np.argsort(code)
            first = _first(code[order])
            ctx = ctx[order[first]]
            by = np.argsort(ctx, kind="stable")
            ctx = ctx[by]
            new = _first(ctx)
            length = np.diff(np.append(new, len(ctx)))
            runs = np.arange(len(new))
            of = np.repeat(runs, length)
            part = _part(ctx[new], self.parts)
            self.ctx = ctx[new]
        rank = np.empty(len(first), np.int64)
        rank[by] = np.arange(len(first))
        entry = np.empty(len(at), np.int64)
        entry[order] = np.repeat(rank, np.diff(np.append(first, len(at))))
        return entry, order[first][by], of, runs, part, length

    def ask(self, block: int) -> pa.Table:
        entry, lead, of, runs, part, length = self.entries()
        at = self.at[lead]
        c = np.bincount(entry, self.held[self.row[self.at]] == 0, len(lead)).astype("<u4")
        word = self.names[self.word[at]]
        if self.level == 1:
            ids = np.empty(int(runs.max(initial=-1)) + 1, np.int64)
            ids[of] = self.word[at - 1]
            ctx, n, up = self.keys[ids[runs]], self.uses[ids[runs]], self.uses[self.word[at]]
        else:
            ctx, n, up = self.ctx[runs], np.empty(0, np.int64), self.p[lead]
        rows = []
        edge = np.append(_first(part), len(part))
        ends = np.append(0, np.cumsum(length))
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            x, y = ends[lo], ends[hi]
            rows.append((int(part[lo]), block, ctx[lo:hi].tobytes(), _packed(length[lo:hi].astype("<u4")), _packed(n[lo:hi]), _packed(word[x:y]), _packed(c[x:y]), _packed(up[x:y])))
        return _table(rows, _ASKED)


def _in_order(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A block's words in order of key, and the place there of each."""
    keys = np.frombuffer(blob, "<u8")
    order = np.argsort(keys)
    rank = np.empty(len(keys), "<u4")
    rank[order] = np.arange(len(keys))
    return keys[order], rank


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else schema.empty_table()


def _read(table: pa.Table) -> tuple[dict, dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The block's own row, and its answers by level."""
    told = pc.is_valid(table.column("level"))
    own = table.filter(pc.invert(told))
    own = {c: own.column(c)[0].as_py() for c in own.column_names if c != "ids"}
    rows = sorted(table.filter(told).select(["level", "part", "n", "gains", "c"]).to_pylist(), key=lambda x: (x["level"], x["part"]))
    answers = {}
    for level in {x["level"] for x in rows}:
        mine = [x for x in rows if x["level"] == level]
        answers[level] = tuple(np.concatenate([_opened(x[k], kind) for x in mine]) for k, kind in (("n", "<i8"), ("gains", "<f8"), ("c", "<i8")))
    return own, answers


def _words(state: DataFrame, parts: int) -> DataFrame:
    """Answers of level 0: a number in the corpus and the uses of each word of a block; and rows without a block, with the sum of
    the uses and the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                keys, rank = _in_order(own["keys"])
                word, to = rank[_opened(own["word"], "<u4")], _opened(own["to"], "<i8")
                learnt = np.repeat(np.frombuffer(own["held"], np.uint8) == 0, np.diff(to))
                c = np.bincount(word[learnt], minlength=len(keys)).astype("<u4")
                part = _part(keys, parts)
                edge = np.append(_first(part), len(part))
                rows = [(int(part[x]), own["block"], None, None, None, keys[x:y].tobytes(), _packed(c[x:y]), None) for x, y in zip(edge[:-1], edge[1:], strict=True)]
                yield from _table(rows, _ASKED).to_batches()

    def summed(table: pa.Table) -> pa.Table:
        X.give_back()
        asked = table.select(["part", "block", "word", "c"]).to_pylist()
        word, c = np.concatenate([np.frombuffer(x["word"], "<u8") for x in asked]), np.concatenate([_opened(x["c"], "<u4") for x in asked])
        keys, at = np.unique(word, return_inverse=True)
        total = np.bincount(at, c, len(keys)).astype("<i8")
        name = np.empty(len(keys), "<i8")  # often used words get small numbers, each task every so manieth
        name[np.argsort(-total, kind="stable")] = np.arange(len(keys)) * parts + asked[0]["part"]
        rows = [(None, 0, asked[0]["part"], None, None, None, int(total.sum()), int((total > 0).sum()))]
        x = 0
        for r in asked:
            y = x + len(r["word"]) // 8
            rows.append((r["block"], 0, r["part"], _packed(name[at[x:y]]), b"", _packed(total[at[x:y]]), None, None))
            x = y
        return _table(rows, _TOLD)

    return state.select("block", "held", "to", "keys", "word").mapInArrow(run, ASKED).repartition(parts, "part").groupBy("part").applyInArrow(summed, TOLD)


def _tested(level: int, n: int, v: int, alpha: float, least: int, gain: float, parts: int):
    def run(table: pa.Table) -> pa.Table:
        """Answers: of each run of a context its count, 0 if it is not kept; of each gram its count (of contexts that are not kept
        only at level 1 if it may be a context itself). Of a word that is a context of many tasks this one's share of the test (gains)."""
        X.give_back()
        asked = table.to_pylist()
        ctx, word = np.concatenate([np.frombuffer(x["ctx"], "<u8") for x in asked]), [_opened(x["word"], "<u8") for x in asked]
        runs, c = (np.concatenate([_opened(x[k], "<u4") for x in asked]).astype(np.int64) for k in ("runs", "c"))
        up = np.concatenate([_opened(x["up"], "<i8" if level == 1 else "<f8") for x in asked])
        uses = np.concatenate([_opened(x["n"], "<i8") for x in asked])
        sizes = [(len(x["ctx"]) // 8, len(w), x["block"], x["part"]) for x, w in zip(asked, word, strict=True)]
        word = np.concatenate(word)
        del asked, table
        names, of = np.unique(ctx, return_inverse=True)
        gram = pair(np.repeat(ctx, runs), word)
        del word, ctx
        order = np.argsort(gram)
        first = _first(gram[order])
        del gram
        lead = order[first]
        total = np.add.reduceat(c[order], first) if len(first) else c
        by, p = np.repeat(of, runs)[lead], up[lead]
        if level == 1:
            p = (p + FIRST) / (n + FIRST * (v + 1))
            count = np.zeros(len(names), np.int64)
            count[of] = uses
            many = _tasks(count, n, parts) > 1
        else:
            count, many = np.bincount(by, total, len(names)).astype(np.int64), np.zeros(len(names), bool)
        with np.errstate(divide="ignore", invalid="ignore"):
            alone = np.where(total > 0, total * np.log((total - 1 + alpha * p) / (count[by] - 1 + alpha) / p), 0.0)
        alone = np.bincount(by, alone, len(names))
        kept = (count >= least) & (alone > gain) | many
        total[~(kept[by] | (total >= least) if level == 1 else kept[by])] = 0
        c[order] = np.repeat(total, np.diff(np.append(first, len(order))))
        left, alone, many = np.where(kept & ~many, count, 0)[of], alone[of], many[of]
        rows = [(None, level, sizes[0][3], None, None, None, int(count[kept].sum()), int(kept.sum()))]
        x = y = 0
        for i, j, block, part in sizes:
            rows.append((block, level, part, _packed(left[x : x + i].astype("<i8")), _packed(alone[x : x + i][many[x : x + i]]), _packed(c[y : y + j].astype("<i8")), None, None))
            x, y = x + i, y + j
        return _table(rows, _TOLD)

    return run


def suffix_tree_scores(docs: DataFrame, held_out: Column, text: str = "text", doc_id: str = "doc_id", alpha: float = ALPHA, least: int = LEAST, gain: float = GAIN, hot: int | None = None, depth: int | None = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), a row per document.

    Learnt from the rows that are not ``held_out`` (null counts as false). A null or empty text is its end alone. Rows
    that repeat are scored and counted each; a row without an id is trained on and scored. If there is nothing to learn
    from, all tokens are unknown with probability 1. An empty table gives an empty one; other columns are not read. Contexts have at most
    ``depth`` words; with None, as many as pass the test. ``hot`` is still taken and has no effect: no keys are broadcast any more.
    """
    parts = max(8, min(20_000, 2 * partitions_of(docs)))
    fold = F.coalesce(held_out, F.lit(False))
    chosen = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), fold.alias("held_out"), F.col(f"`{text}`").cast("string").alias(TEXT))
    # written once: answers are in the order of one run of each task
    state = materialize(_blocks(chosen), "blocks")
    told = [materialize(_words(state, parts), "words")]
    sums = told[0].agg(F.sum("total").alias("n"), F.sum("kept").alias("v")).first()
    n, v = int(sums["n"] or 0), int(sums["v"] or 0)

    def known(light: bool) -> DataFrame:
        """Blocks and their answers, a block's together."""
        rows = [state.drop(*HEAVY) if light else state, *[t.where("block is not null").select("block", "level", "part", "n", "gains", "c") for t in told]]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
        return (rows if told else rows.withColumn("level", F.lit(None).cast("int")).withColumns({c: F.lit(None).cast("int" if c == "part" else "binary") for c in ("part", "n", "gains", "c")})).repartition(parts, "block").groupBy("block")

    def ask(table: pa.Table) -> pa.Table:
        X.give_back()
        own, answers = _read(table)
        return _Block(own, answers, n, v, alpha, least, gain, parts).ask(own["block"])

    def settled(table: pa.Table) -> pa.Table:
        X.give_back()
        own, answers = _read(table)
        mine = _Block(own, answers, n, v, alpha, least, gain, parts)
        ids = table.filter(pc.is_null(table.column("level"))).column("ids")
        values = {"block": own["block"], "ids": ids, "held": own["held"], "to": own["to"], "keys": _packed(mine.named), "word": own["word"], "at": _packed(mine.at.astype("<i8")), "p": _packed(mine.p), "known": mine.known.astype("<f8").tobytes(), "base": mine.base.tobytes(), "score": mine.score.tobytes(), "depth": mine.level - 1}
        return pa.table({c: x if c == "ids" else pa.array([x], pa.int64() if c == "block" else pa.int32() if c == "depth" else pa.binary()) for c, x in values.items()})

    level = 1
    while n and (depth is None or level <= depth):
        found = known(True).applyInArrow(ask, ASKED).repartition(parts, "part").groupBy("part").applyInArrow(_tested(level, n, v, alpha, least, gain, parts), TOLD)
        found = materialize(found, f"level{level}")
        if not found.agg(F.sum("kept")).first()[0]:
            release(found)
            break
        told.append(found)
        if level == SETTLE and level != depth:
            after = materialize(known(False).applyInArrow(settled, state.schema), "settled")
            release(state, *told)
            state, told = after, []
        level += 1

    out = T.StructType([chosen.schema["doc_id"], T.StructField("held_out", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")], *[T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]])
    arrow = to_arrow_schema(out)

    def scored(table: pa.Table) -> pa.Table:
        X.give_back()
        own, answers = _read(table)
        mine = _Block(own, answers, n, v, alpha, least, gain, parts)
        mine._settle(np.zeros(len(mine.at), bool))
        ids = table.filter(pc.is_null(table.column("level"))).column("ids").combine_chunks().flatten()
        values = [ids.cast(arrow.field(0).type), pa.array(mine.held > 0), pa.array(np.diff(mine.to)), pa.array(mine.known.astype(np.int64)), pa.array(np.full(len(ids), n)), pa.array(mine.base), pa.array(mine.score)]
        return pa.table(values, schema=arrow)

    scores = materialize(known(False).applyInArrow(scored, out), "scores")
    release(state, *told)
    return scores
