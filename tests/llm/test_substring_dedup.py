import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholium.llm import substring_dedup as D
from scholium.llm.substring_dedup import FMIndex, least_documents, remove_repeats, sliding_min, stride, substring_dedup
from tests.llm import cases


def brute(rows, k=50):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in split:
        for p in range(len(w) - k + 1):
            if i is not None:
                key = tuple(w[p : p + k])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - k + 1):
            if i is not None and first[tuple(w[p : p + k])] < i:
                gone.update(range(p, p + k))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(map(str, out))


def corpus():
    rng = random.Random(4)
    rows = [(i, t) for i, t, *_ in cases.rows()] + [(None, cases.rows()[6][1])]
    passages = [cases.sentence(rng, n, 10**6) for n in (49, 50, 51, 60, 120, 400)]
    for i in range(150):
        parts = [cases.sentence(rng, rng.randrange(0, 60)) if rng.random() < 0.6 else rng.choice(passages) for _ in range(rng.randrange(1, 6))]
        rows.append((rng.randrange(1000, 3000) * 200 + i, " ".join(parts)))
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("th", F.lit(1)).repartition(5)
    assert sorted(str(tuple(r)) for r in substring_dedup(df).collect()) == brute(rows)


def test_empty_table_and_kept_columns(spark):
    assert substring_dedup(cases.empty(spark)).collect() == []
    got = remove_repeats(cases.table(spark), keep=("doc_id", "lang"))
    assert got.columns == ["doc_id", "lang", "n_words", "n_removed", "kept"] and got.count() == len(cases.rows())


def test_index_counts_like_a_scan():
    rng = np.random.default_rng(3)
    x = rng.integers(1, 4, 500)
    x[rng.integers(0, 500, 20)] = 0
    index = FMIndex(np.append(x, 0), 8)
    for k in (1, 3, 8):
        starts = np.array([s for s in range(500 - k) if x[s : s + k].all()])
        for least in (1, 3, 9):
            matched, first = index.search(x, starts, k, least)
            for s, n, p in zip(starts.tolist(), matched.tolist(), first.tolist(), strict=True):
                end = s + k
                often = [sum((x[i : i + j] == x[end - j : end]).all() for i in range(500 - j + 1)) for j in range(1, k + 1)]
                assert n == sum(c >= least for c in often)
                assert n == 0 or (x[index.suffixes[p] : index.suffixes[p] + n] == x[end - n : end]).all()
    assert sliding_min(np.array([3, 1, 2, 5, 4]), 3).tolist() == [1, 1, 2]


def test_pieces_agree_with_one_index():
    rng = np.random.default_rng(5)
    parts = [rng.integers(0, 3, n).astype(np.uint64) for n in rng.integers(4, 40, 60)]
    for p in parts[::3]:
        p[len(p) // 2] = 1000 + len(p)
    doc = rng.permutation(60)
    size = np.array([len(p) for p in parts])
    want = [[min(int(d) for p, d in zip(parts, doc, strict=True) if any((p[j : j + 4] == q[i : i + 4]).all() for j in range(len(p) - 3))) for i in range(len(q) - 3)] for q in parts]
    for limit in (10**6, 100):
        assert least_documents(np.concatenate(parts), size, doc, 4, limit).tolist() == sum(want, [])
    assert [stride(k) for k in (1, 4, 7, 12, 50)] == [1, 2, 1, 3, 5]


@pytest.mark.parametrize("near", [False, True])
def test_a_segment_is_sent_once_and_only_beside_others_of_its_key(spark, monkeypatch, near):
    """Equal texts need no search; of near copies each distinct segment travels from one document."""
    rng = random.Random(8)
    texts = [cases.sentence(rng, 300, 10**6) for _ in range(4)]
    if near:
        texts += [t.replace(t.split(" ")[150], "otherwise") for t in texts]
    rows = [(c * 10 + i, t) for c in range(5) for i, t in enumerate(texts)]
    sent = []

    def counted(*args, f=D._bodies):
        found = f(*args)
        sent.extend(np.frombuffer(r["segs"], D.SEG)[["g", "digest"]].tolist() for r in found.collect())
        return found

    monkeypatch.setattr(D, "_bodies", counted)
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5, "doc_id")).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)
    sent = sum(sent, [])
    assert len(sent) == len(set(sent)) and bool(sent) == near


def test_memory_of_a_shard():
    """A shard's search holds at most 120 bytes a word, with its words."""
    rng = np.random.default_rng(1)
    words = rng.integers(0, 5000, (3000, 100)).astype(np.uint64)
    words[:, 20:80] = words[0, 20:80]
    words[np.arange(3000), 70 + np.arange(3000) % 10] = 9999
    tracemalloc.start()
    found = least_documents(words.ravel(), np.full(3000, 100), rng.permutation(3000), 50)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 3000 * 51 and most < 120 * words.size
