import re

import zstandard
from pyspark.sql import functions as F

from scholium.llm.quality_rules import bands_failed, compression_bands
from tests.llm import cases


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = {g for g in grams if grams.count(g) > 1} if len(grams) < 3000 else None
    if often is None:
        from collections import Counter

        often = {g for g, n in Counter(grams).items() if n > 1}
    covered = {j for i, g in enumerate(grams) if g in often for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, rep = len(words), len(covered)
    base = n < 10 or 100 * rep > 20 * n
    band = bands_failed((text or "").encode(), zstandard.ZstdCompressor(level=3))[1]
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), rep, base, not base and not band


def test_counts_against_brute_force(spark):
    got = {r.doc_id: r for r in compression_bands(cases.table(spark)).collect()}
    assert len(got) == len(cases.rows())
    for doc_id, text, *_ in cases.rows():
        r = got[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == brute(text), text and text[:60]


def test_bands_reject_repeats_and_noise_but_not_prose(spark):
    import base64
    import random

    press = zstandard.ZstdCompressor(level=3)
    rng = random.Random(3)
    assert bands_failed(b"spam and eggs " * 200, press)[1]
    assert bands_failed(base64.b64encode(rng.randbytes(6000)), press)[1]
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(3000)).encode()
    assert not bands_failed(prose, press)[1]
    half = prose[:8192] + b"again and again " * 512
    assert bands_failed(half, press)[1]


def test_noise_fails_and_prose_passes_at_every_length():
    import base64
    import random

    import pyarrow.parquet as pq

    press = zstandard.ZstdCompressor(level=3)
    rng = random.Random(11)
    long = [t.encode() for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() if t and len(t) > 3000]

    def tokens(n):
        out = b""
        while len(out) < n:
            out += base64.b64encode(rng.randbytes(12))[: rng.randrange(4, 16)] + b" "
        return out[:n]

    for low, high in ((128, 160), (160, 192), (192, 224), (224, 256), (256, 320), (320, 384), (384, 448), (448, 512), (512, 640), (640, 768), (768, 1024), (1024, 4096), (4096, 9000)):
        for _ in range(60):
            n = rng.randrange(low, high)
            assert bands_failed(tokens(n), press)[1], n
            assert bands_failed(base64.encodebytes(rng.randbytes(n))[:n], press)[1], n
            text = rng.choice(long)
            at = rng.randrange(max(1, len(text) - n))
            ratio, failed = bands_failed(text[at : at + n], press)
            # some documents repeat a line: those may fail by the upper limit
            assert len(text[at : at + n]) < low or not failed or ratio > 2.5, (n, ratio)


def test_clashing_names_and_empty_table(spark):
    docs = cases.table(spark).withColumn("kept", F.lit("x")).withColumn("a b", F.lit(1))
    out = compression_bands(docs, keep=tuple(docs.columns))
    assert out.columns.count("kept") == 1 and dict(out.dtypes)["kept"] == "boolean" and "a b" in out.columns
    assert compression_bands(cases.empty(spark)).count() == 0
