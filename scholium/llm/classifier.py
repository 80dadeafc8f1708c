"""Quality by pairwise ranking (Bradley-Terry).

A document has a strength w . x of its features; that one document is better than another has the probability
sigmoid(w . (x - y)). Preference pairs are drawn between labelled documents of the two labels, w is fitted by the
logistic loss on the features' differences (Newton steps with a small ridge), so nothing but the order counts.
The threshold is a quantile of the training strengths: the share of label 0 among the labels. Strengths are mapped
to scores by a logistic curve that puts the threshold at ``CUT``.

The fit takes a bounded sample of labelled rows (``ROWS``, a parameter, by the order of a hash of the id) and
``PAIRS`` pairs; features and scores are computed for every document, over its whole text.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholium.llm import text as X
from scholium.llm.quality_rules import base_counts
from scholium.llm.rows import map_rows

ROWS = 20_000
PAIRS = 200_000
CUT = 0.3
SEED = 11
NAMES = ("symbols", "symbol_words", "upper", "upper_words", "digits", "exclaims", "pipes", "other", "dup_lines", "repeat_words", "distinct", "top_word", "ratio", "word_length", "long_words", "log_words", "same_next", "empty")

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>@^~=+_\\{}[]")] = True
_PLAIN = _LETTER | _DIGIT | X.WS
_PLAIN[list(b".,;:'\"-!?()")] = True


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of features (``NAMES``) for each text; shares and logarithms, all finite, zeros for an empty text but the last."""
    n, chars, _, dup, repeat = (x.astype(float) for x in base_counts(data, offs))
    size = np.diff(offs).astype(float)
    s, e, wo = X.words(data, offs)
    row = X.row_of(wo)
    rows = len(offs) - 1
    some = np.maximum(size, 1)
    words = np.maximum(n, 1)

    def share(mask):
        return X.sums_by_row(mask[data], offs) / some

    def any_in(mask):
        total = np.concatenate([[0], np.cumsum(mask[data])])
        return total[e] - total[s]

    upper, letters, length = any_in(_UPPER), any_in(_LETTER), e - s
    h = X.word_hashes(X.LOWER[data], s, e)
    key = X.mix(h ^ X.mix(row.astype(np.uint64)))
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    run = np.diff(np.append(np.flatnonzero(new), len(key)))
    owner = row[order[new]]
    distinct = np.bincount(owner, minlength=rows)
    top = np.zeros(rows)
    np.maximum.at(top, owner, run)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    press = zstandard.ZstdCompressor(level=1)
    raw = data.tobytes()
    packed = np.array([len(press.compress(raw[a:b])) if b > a else 1 for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], float)

    def of_words(mask):
        return np.bincount(row[mask], minlength=rows) / words

    lines = np.maximum(X.sums_by_row(data == 10, offs) + 1.0, 1)
    out = [
        share(_SYMBOL),
        of_words(any_in(_SYMBOL) > 0),
        X.sums_by_row(_UPPER[data], offs) / np.maximum(X.sums_by_row(_LETTER[data], offs), 1),
        of_words((upper >= 2) & (upper >= 0.5 * letters)),
        share(_DIGIT),
        X.sums_by_row(data == 33, offs) / words,
        X.sums_by_row(data == 124, offs) / words,
        share(~_PLAIN),
        dup / lines,
        repeat / words,
        np.log(np.maximum(distinct, 1)) / np.log(np.maximum(n, 1) + 1),
        top / words,
        np.log(np.maximum(size / packed, 0.1)) - 0.12 * np.log(np.maximum(size, 1)),
        np.log(np.maximum(chars, 1) / words),
        of_words(length > 40),
        np.log(words) / 10,
        of_words(again),
        (n == 0).astype(float),
    ]
    return np.stack([np.where(n == 0, 0.0, x) for x in out[:-1]] + [out[-1]], axis=1)


class Model:
    """w over standardised, clipped features, and the line from strengths to scores."""

    def __init__(self, mean, scale, w, shift, slope):
        self.mean, self.scale, self.w, self.shift, self.slope = mean, scale, w, shift, slope

    def score(self, x: np.ndarray) -> np.ndarray:
        strength = np.clip((x - self.mean) / self.scale, -8, 8) @ self.w
        return 1 / (1 + np.exp(-np.clip((strength - self.shift) * self.slope + np.log(CUT / (1 - CUT)), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = SEED) -> Model:
    """Bradley-Terry weights from pairs of a row with label 1 and one with label 0. With one label only, all scores are alike."""
    d = len(NAMES)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(d), np.ones(d), np.zeros(d), 0.0 if len(good) or not len(bad) else 1.0, 1.0)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    diff = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(d)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -40, 40)))
        g = diff.T @ (p - 1) / pairs + ridge * w
        h = (diff * (p * (1 - p))[:, None]).T @ diff / pairs + ridge * np.eye(d)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    strength = z @ w
    share = len(bad) / (len(good) + len(bad))
    order = np.sort(strength)
    k = min(max(int(round(share * len(order))), 1), len(order) - 1)
    spread = max(float(np.median(strength[good]) - np.median(strength[bad])), 1e-3)
    return Model(mean, scale, w, float((order[k - 1] + order[k]) / 2), 6 / spread)


def _feature_rows(docs: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    def start():
        import pyarrow as pa

        def block(data, offs, valid):
            x = features(data, offs)
            return [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))]

        return block

    return map_rows(docs, start, [T.StructField("__x", T.ArrayType(T.DoubleType()))], text, keep)


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", rows: int = ROWS) -> Model:
    """The model from at most ``rows`` labelled documents. Labels other than 0 and 1 and null ids are left out; of an id that has both, either row counts."""
    chosen = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__y"))
    # at most `rows` rows of two numbers each: small enough to broadcast whatever the corpus
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id", "__y").limit(rows)
    sample = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("__t")).join(F.broadcast(chosen), "__id").select("__y", "__id", "__t")
    found = _feature_rows(sample, "__t", ("__y", "__id")).orderBy("__id", "__y").limit(rows).collect()
    x = np.array([r["__x"] for r in found], float).reshape(len(found), len(NAMES))
    return fit(x, np.array([r["__y"] for r in found], int))


def with_quality(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``score`` in 0..1 and ``predicted``.

    Null and empty texts score by the features of an empty text; repeated rows get equal scores; an empty table
    gives an empty one; of a kept column that has the name of a result, the result stays.
    """
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def start():
        def block(data, offs, valid):
            score = model.score(features(data, offs))
            return [score, (score >= CUT).astype(np.int32)]

        return block

    return map_rows(docs, start, fields, text, keep)


def quality_ranking(docs: DataFrame, labels: DataFrame, held_out: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted: learnt from the labels of rows that are not ``held_out`` (a predicate on the id; null counts as false)."""
    learnable = labels.where(~F.coalesce(held_out, F.lit(False)))
    model = learn(docs, learnable, text, doc_id)
    out = with_quality(docs.withColumn("held_out", F.coalesce(held_out, F.lit(False))), model, text, (doc_id, "held_out"))
    return out.select(doc_id, "held_out", "score", "predicted")
