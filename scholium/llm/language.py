"""Language identification by cross-parsing entropy over suffix automata.

For each language a suffix automaton of labelled text is built: it accepts exactly the substrings of that text. A
document is parsed greedily into longest substrings of each language's text (cross-parsing); the fewer phrases it
takes, a character, the closer the languages. Phrase counts are normalised by the logarithm of the training
text's length, so a language with less text is not at a disadvantage; the least wins.

All documents of a block walk all automata in lockstep: texts are cut into segments of ``SEGMENT`` characters,
each parsed from the root, and every step is one gather in a dense transition table over the frequent characters; transitions by all other
characters of the training texts are few and stand as sorted keys.
The models come from a bounded sample (``CHARS`` characters a language, at most ``EACH`` of one document, by the
order of a hash of the id); every document is parsed as a whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholium.llm import bpe
from scholium.llm import text as X
from scholium.llm.packing import lower_table
from scholium.llm.rows import map_rows, remainder

CHARS = 40_000
EACH = 2_000
SEGMENT = 256
ALPHABET = 64
UNKNOWN = "und"


def normalised(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points with one blank in place of each run of anything but letters; rows' offsets; letters of each row."""
    cps, at = bpe.code_points(data)
    ro = np.searchsorted(at[:-1], offs)
    cls = bpe.classes()[cps] == bpe.LETTER
    out = np.where(cls, lower_table()[cps], 32).astype(np.uint32)
    keep = cls.copy()
    if len(cls):
        keep[1:] |= cls[:-1]  # the blank right behind a letter
    letters = X.sums_by_row(cls, ro)
    ends = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], ends[ro], letters


class Automaton:
    """Suffix automaton, as a dense table of transitions by symbols below ``size`` (-1 where there is none); ``others`` has (state, symbol, next) of the rest."""

    def __init__(self, symbols: list[int], size: int):
        nexts: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            cur = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(nexts)
                    nexts.append(dict(nexts[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.table = np.full((len(nexts), size), -1, np.int32)
        others = []
        for s, x in enumerate(nexts):
            for c, to in x.items():
                if c < size:
                    self.table[s, c] = to
                else:
                    others.append((s, c, to))
        self.others = np.array(others, np.int64).reshape(-1, 3)


class Model:
    """Automata of all languages behind one another in one table; symbol 0 is any character that no training text has."""

    def __init__(self, texts: dict[str, str], size: int = ALPHABET):
        from collections import Counter

        self.languages = sorted(texts)
        # all characters of the languages, the most frequent first (each language with the same weight): those are dense
        weight: Counter = Counter()
        for t in texts.values():
            for c, n in Counter(t).items():
                weight[c] += n / max(1, len(t))
        self.alphabet = "".join(sorted(weight, key=lambda c: (-weight[c], c)))
        self.lut = np.zeros(0x110000, np.int32)
        for i, c in enumerate(self.alphabet):
            self.lut[ord(c)] = i + 1
        self.symbols = len(self.alphabet) + 1
        self.size = min(size, self.symbols)
        others = []
        tables, roots, at = [], [], 0
        for name in self.languages:
            symbols = self.lut[[ord(c) for c in texts[name]]].tolist() if texts[name] else []
            built = Automaton(symbols, self.size)
            table = built.table
            others.append(np.stack([(built.others[:, 0] + at) * self.symbols + built.others[:, 1], built.others[:, 2] + at]))
            tables.append(np.where(table >= 0, table + at, -1))
            roots.append(at)
            at += len(table)
        self.dead = at  # behind a character that no substring has, the next begins a phrase
        self.table = np.concatenate([*tables, np.full((1, self.size), -1, np.int32)]).ravel().astype(np.int32)
        keys, to = np.concatenate([np.empty((2, 0), np.int64), *others], axis=1)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], to[order].astype(np.int32)
        self.roots = np.array(roots, np.int32)
        self.norm = np.log([max(2, len(texts[n])) for n in self.languages])

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The next states of rows of states by the symbol of each row; -1 where there is none."""
        rare = np.flatnonzero(c >= self.size)
        if not len(rare):
            return self.table[state * self.size + c[:, None]]
        to = self.table[state * self.size + np.where(c < self.size, c, 0)[:, None]]
        want = np.broadcast_to(state, to.shape)[rare].astype(np.int64) * self.symbols + c[rare, None]
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        to[rare] = np.where(self.keys[at] == want, self.to[at], -1)
        return to

    def phrases(self, symbols: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Phrases of every row in each language, parsed by segments."""
        rows, langs = len(offs) - 1, len(self.languages)
        n = -(-np.diff(offs) // SEGMENT)
        row = np.repeat(np.arange(rows), n)
        first = np.concatenate([[0], np.cumsum(n)])[:-1]
        start = offs[row] + (np.arange(len(row)) - first[row]) * SEGMENT
        size = np.minimum(offs[row + 1] - start, SEGMENT)
        order = np.argsort(-size, kind="stable")
        start, size, row = start[order], size[order], row[order]
        state = np.tile(self.roots, (len(row), 1))
        count = (np.zeros((len(row), langs), np.int32))
        alive = np.searchsorted(-size, -np.arange(SEGMENT), "left")  # segments longer than i
        home = self.roots[None, :]
        for i in range(SEGMENT):
            m = int(alive[i])
            if not m:
                break
            c = symbols[start[:m] + i].astype(np.int32)
            to = self.step(state[:m], c)
            miss = to < 0
            # a phrase ends before this character, and the next begins with it
            if i:
                count[:m] += miss
            again = self.step(home, c)
            again = np.where(again < 0, np.int32(self.dead), again)
            state[:m] = np.where(miss, again, to)
        count += 1
        out = np.zeros((rows, langs), np.int64)
        np.add.at(out, row, count)
        return out

    def predict(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language (-1: none) and score of each row."""
        cps, ro, letters = normalised(data, offs)
        if not self.languages:
            return np.full(len(offs) - 1, -1), np.zeros(len(offs) - 1)
        cost = self.phrases(self.lut[cps], ro) * self.norm
        best = cost.argmin(1)
        least = cost[np.arange(len(cost)), best]
        if cost.shape[1] > 1:
            second = np.partition(cost, 1, axis=1)[:, 1]
            score = np.where(second > 0, 1 - least / np.maximum(second, 1e-9), 0.0)
        else:
            score = np.ones(len(cost))
        return np.where(letters > 0, best, -1), np.where(letters > 0, np.clip(0.5 + score, 0, 1), 0.0)


def _passage(text: Column, size: int) -> Column:
    """``size`` characters from a place that a hash of the text picks."""
    return F.substring(text, (F.pmod(F.xxhash64(text), F.greatest(F.length(text) - size, F.lit(0)) + 1) + 1).cast("int"), F.lit(size))


def learn(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", chars: int = CHARS, each: int = EACH) -> Model:
    """Models from the labelled rows of ``docs``: for each language the documents that come first by a hash of their id, until ``chars`` characters are full."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(f"`{lang}`").cast("string").alias("__l"), F.col(f"`{doc_id}`").alias("__id"), _passage(F.col(f"`{text}`"), each).alias("__t")).where(F.length(F.trim("__t")) > 0)
    # what is sure to be no letter goes as one blank, so lengths are about those of the normalised passages
    rows = rows.withColumn("__s", F.regexp_replace("__t", r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", " "))
    counts = {r["__l"]: (r["n"], r["s"]) for r in rows.groupBy("__l").agg(F.count("*").alias("n"), F.sum(F.length("__s")).alias("s")).collect()}
    hashed = F.pmod(F.xxhash64("__id", "__t"), F.lit(1 << 30))
    picked = F.lit(False)
    total = 0
    for name, (n, size) in counts.items():
        # rows of about four times the characters that are wanted, whatever the language's share and passages
        want = -(-4 * chars * n // max(1, size))
        total += min(n, want)
        picked = picked | ((F.col("__l") == name) & (hashed < min(1 << 30, int((1 << 30) * want / n) + 1)))
    found = rows.where(picked).select("__l", hashed.alias("__h"), "__t", "__s").orderBy("__h", "__t").limit(8 * max(1, total)).collect()
    texts: dict[str, list[str]] = {}
    for r in found:
        texts.setdefault(r["__l"], []).append(r["__s"])
    out = {}
    for name, parts in texts.items():
        data = "\n".join(parts).encode()
        cps, _, _ = normalised(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        joined = cps[:chars].tobytes().decode("utf-32-le")
        if joined.strip():
            out[name] = joined
    return Model(out)


def with_language(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` (0.5: two languages fit alike; towards 1: one fits much better).

    A text that is null or has no letter is ``und`` with score 0. Ties go to the first language by name; repeated
    rows get equal results; an empty table gives an empty one; of a kept column that has the name of a result,
    the result stays.
    """
    names = np.array([*model.languages, UNKNOWN], object)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 * CHARS states a language

    def start():
        m = shared.value

        def block(data, offs, valid):
            best, score = m.predict(data, offs)
            return [names[best].tolist(), score]

        return block

    return map_rows(docs, start, fields, text, keep)


def language_of(docs: DataFrame, held_out: Column, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score: learnt from rows that are not ``held_out`` (null counts as false)."""
    fold = F.coalesce(held_out, F.lit(False))
    model = learn(docs.where(~fold), text, doc_id, lang)
    return with_language(docs.withColumn("held_out", fold), model, text, (doc_id, "held_out")).select(doc_id, "held_out", "lang_pred", "score")


def learn_fold(docs: DataFrame) -> Model:
    """The model of the rows whose remainder modulo 3 is not 1."""
    return learn(docs.where(F.coalesce(remainder("doc_id", 3) != 1, F.lit(True))))
