"""Quality rules by compression bands.

A text is compressed with zstandard as a whole and in fixed chunks of ``CHUNK`` bytes. Its ratio (bytes before /
after) must lie in a band that depends on the length: repetitive text compresses too well, random text (keys,
base64, noise) too little. A document fails if the whole lies outside its band, or if chunks outside theirs make
up at least ``SHARE`` of it. Beside that, two plain rules (too few words; too many words in repeated 5-word
windows) fail a document before its bands count.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from scholium.llm import text as X
from scholium.llm.rows import map_rows

LEVEL = 3
CHUNK = 4096
SHARE = 0.25
#: From this many bytes on: least and greatest ratio. Short texts carry the frame's overhead and little context, so both
#: noise and prose compress less the shorter they are. The least ratios under 1 KB lie between the greatest of 1,500 base64
#: texts a class (with blanks or MIME lines: 1.03 at 128 bytes, 1.12 at 256, 1.23 at 512, 1.28 at 768) and the least of
#: prose (1.08, 1.32, 1.43, 1.57). Under 128 bytes zstd stores most of either as it is (0.88 to 0.98 both): no least ratio.
#: From 1 KB on prose stays near 1.7 to 3, base64 under 1.35, repeated lines beyond 5.
BANDS = (
    *((0, 0.0, 4.0), (128, 1.04, 2.75), (160, 1.055, 2.75), (176, 1.065, 2.75), (192, 1.1, 2.75), (224, 1.125, 2.75)),
    *((256, 1.14, 3.0), (320, 1.17, 3.0), (384, 1.2, 3.0), (448, 1.22, 3.0)),
    *((512, 1.25, 3.25), (640, 1.275, 3.25), (768, 1.32, 3.25)),
    *((1024, 1.36, 3.5), (4096, 1.4, 4.0), (16384, 1.45, 4.5), (65536, 1.45, 5.5)),
)

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
FIELDS = [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("ratio", T.DoubleType()),
    T.StructField("band_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
]


def _outside(size: int, ratio: float, bands: tuple) -> bool:
    low, high = next((lo, hi) for least, lo, hi in reversed(bands) if size >= least)
    return not low <= ratio <= high


def bands_failed(text: bytes, press: zstandard.ZstdCompressor, bands: tuple = BANDS, chunk: int = CHUNK, share: float = SHARE) -> tuple[float, bool]:
    """Ratio of the whole, and whether the text lies outside its bands. An empty text has ratio 1 and passes."""
    if not text:
        return 1.0, False
    ratio = len(text) / len(press.compress(text))
    if _outside(len(text), ratio, bands):
        return ratio, True
    if len(text) <= chunk:
        return ratio, False
    bad = 0
    for i in range(0, len(text), chunk):
        part = text[i : i + chunk]
        bad += len(part) * _outside(len(part), len(part) / len(press.compress(part)), bands)
    return ratio, bad >= share * len(text)


def base_counts(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    rows = len(offs) - 1
    s, e, wo = X.words(data, offs)
    sums = X.prefix(X.CODE[data])
    inside = ~X.WS[data]
    chars = X.sums_by_row(inside & ((data & 0xC0) != 0x80), offs)
    symbols = X.sums_by_row(SYMBOLS[data], offs)

    # lines: cut at \n and at the rows' ends
    nl = np.flatnonzero(data == 10)
    ls = np.sort(np.concatenate([offs[:-1], nl + 1]), kind="stable")
    le = np.sort(np.concatenate([offs[1:], nl]), kind="stable")
    seen = np.concatenate([[0], np.cumsum(inside)])
    has = seen[le] > seen[ls]
    ls, le = ls[has], le[has]
    row = np.searchsorted(offs, ls, "right") - 1
    key = X.mix(X.span(sums, ls, le) ^ X.mix(row.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    dup = np.bincount(row[again], minlength=rows)

    w = X.span(sums, s, e)
    at, wino = X.windows(wo, 5)
    key = np.zeros(len(at), np.uint64)
    for k in range(5):
        key += w[at + k] * X.CODE[k]
    key = X.mix(key ^ X.mix(X.row_of(wino).astype(np.uint64)))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    cover = np.zeros(len(s) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 5, -1)
    repeat = X.sums_by_row(np.cumsum(cover)[:-1] > 0, wo)
    return [np.diff(wo), chars, symbols, dup, repeat]


def compression_bands(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), bands: tuple = BANDS, chunk: int = CHUNK, share: float = SHARE) -> DataFrame:
    """``keep`` columns, the base counts, ``base_failed``, ``ratio``, ``band_failed`` and ``kept``, a row for each document.

    A null or empty text counts as no words: base_failed, not kept, ratio 1. Texts are read whole whatever their
    length; repeated rows give repeated results; an empty table gives an empty one. Of a kept column that has
    the name of a result, the result stays.
    """

    def start():
        press = zstandard.ZstdCompressor(level=LEVEL)

        def block(data, offs, valid):
            counts = base_counts(data, offs)
            n, repeat = counts[0], counts[4]
            failed = (n < 10) | (100 * repeat > 20 * n)
            raw = data.tobytes()
            both = [bands_failed(raw[a:b], press, bands, chunk, share) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            band = np.array([b for _, b in both], bool)
            return [*counts, failed, np.array([r for r, _ in both], float), band, ~failed & ~band]

        return block

    return map_rows(docs, start, FIELDS, text, keep)
