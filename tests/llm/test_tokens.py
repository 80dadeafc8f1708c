import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from scholium.llm import byte_bpe, packing
from scholium.llm import text as X
from tests.llm import cases

RANKS = P.path("byte_bpe_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def word_library():
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return t


def odd(n, seed=5):
    rng = random.Random(seed)
    letters = " \n\t\r'sldmtrevaéÀ1²½.,!-_　\xa0\x85日Ωǅ😀́\x1cΣİi̇<|endoftext|>"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_byte_ids_are_the_librarys(library):
    enc = byte_bpe.Encoder(RANKS, limit=500)  # small: the cache is emptied on the way
    for texts in (cases.texts(), odd(400), odd(400, 6)):
        data, offs = X.flatten(pa.array(texts, pa.string()))
        ids, io, _, _ = enc.encode(data, offs)
        for i, t in enumerate(texts):
            assert ids[io[i] : io[i + 1]].tolist() == library.encode_ordinary(t or ""), repr(t)[:80]
            assert byte_bpe.decode(ids[io[i] : io[i + 1]], enc.v.tokens) == (t or "").encode()


def test_digests(spark, library):
    got = {r.doc_id: r for r in byte_bpe.with_byte_bpe(cases.table(spark), RANKS, ids="ids").collect()}
    assert len(got) == len(cases.rows())
    for doc_id, t, *_ in cases.rows():
        want, r = library.encode_ordinary(t or ""), got[doc_id]
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.with_byte_bpe(cases.empty(spark), RANKS).count() == 0


def test_word_ids_are_the_librarys(word_library):
    enc = packing.WordEncoder(WORDS, limit=500)
    for texts in (cases.texts(), odd(400), odd(400, 8)):
        data, offs = X.flatten(pa.array(texts, pa.string()))
        ids, io = enc.encode(data, offs)
        for i, t in enumerate(texts):
            assert ids[io[i] : io[i + 1]].tolist() == word_library.encode(t or "", add_special_tokens=False).ids, repr(t)[:80]


def test_packing_loses_nothing_and_pads_little(spark, word_library):
    got = packing.harmonic_pack(cases.table(spark), WORDS).collect()
    want = {i: np.array([*word_library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t, *_ in cases.rows()}
    docs, sequences = {}, {}
    for r in got:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert docs.keys() == want.keys()
    for i, pieces in docs.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(want[i])
            at += r.length
            assert r.ids_crc32 == zlib.crc32(want[i][r.start : at].tobytes())
        assert at == len(want[i])
    padding = total = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        total += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding < 0.02 * total
    assert packing.harmonic_pack(cases.empty(spark), WORDS).count() == 0


def test_harmonic_classes_take_a_fixed_count():
    out = []
    p = packing.Packer(lambda *a: out.append(a), 0)
    for i in range(1000):
        p.add(i, np.zeros(205, np.int32))  # class 19
    by = {}
    for doc, start, ids, total, sequence, offset in out:
        by.setdefault(sequence, []).append(len(ids))
    assert len(by) == 1000 // 19 and all(x == [205] * 19 for x in by.values())
    p.finish()
    assert sum(len(a[2]) for a in out) == 205_000


def test_columns_with_the_names_of_results_give_way(spark):
    from pyspark.sql import functions as F

    from scholium.llm.byte_bpe import with_byte_bpe
    from scholium.llm.packing import harmonic_pack
    from scholium.llm.queries import vocabulary
    from tests.llm import cases

    docs = cases.table(spark)
    odd = docs.withColumn("n_tokens", F.lit("mine")).withColumn("sequence_id", F.lit("mine")).withColumn("ids_sha256", F.lit("mine"))
    path = vocabulary("byte_bpe_50k.tiktoken")
    a = with_byte_bpe(docs, path)
    b = with_byte_bpe(odd, path, keep=("doc_id", "n_tokens", "ids_sha256"))
    assert sorted(b.columns) == sorted(a.columns) and sorted(map(str, b.select(*a.columns).collect())) == sorted(map(str, a.collect()))
    path = vocabulary("word_bpe_49k.json")
    assert sorted(map(str, harmonic_pack(odd, path).drop("sequence_id", "offset").collect())) == sorted(map(str, harmonic_pack(docs, path).drop("sequence_id", "offset").collect()))
    assert harmonic_pack(cases.empty(spark), path).collect() == []
