import random
import re

import numpy as np
from pyspark.sql import functions as F

from scholium.llm.components import components
from scholium.llm.jaccard_join import ngram_jaccard_join, ngram_jaccard_links, overlaps
from tests.llm import cases


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}
    links = dict.fromkeys(root, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1 :]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                links[i], links[j] = links[i] + 1, links[j] + 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {(i, len(a), find(i), links[i]) for i, a in sets}


def edited(rng, words, share):
    return " ".join("e" + str(rng.randrange(10**6)) if rng.random() < share else w for w in words)


def corpus():
    rng = random.Random(9)
    rows = [(i, t) for i, t, *_ in cases.rows()]
    at = 1000
    for _ in range(6):
        base = cases.sentence(rng, rng.randrange(5, 200), 10**5).split()
        for _ in range(rng.randrange(2, 40)):
            rows.append((at, edited(rng, base, rng.choice([0, 0.005, 0.01, 0.03, 0.06, 0.1]))))
            at += rng.randrange(1, 4)
    rng.shuffle(rows)
    return rows


def test_components_of_near_copies(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("d1", F.lit("clash")).withColumn("n_shingles", F.lit("x")).repartition(5)
    got = ngram_jaccard_join(df, bits=16)
    assert {tuple(r) for r in got.collect()} == brute(rows) and got.count() == len(rows)


def test_all_links_within_a_group_are_listed(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    members, links = ngram_jaccard_links(df, bits=16)
    members = members.collect()
    joined = {((r.a_1, r.a_2), (r.b_1, r.b_2)) for r in links.collect()}
    cls = {r.doc_id: (r.class_1, r.class_2) for r in members}
    sets = {i: shingles(t) for i, t in rows}
    n = dict.fromkeys(sets, 0)
    for i, a in sets.items():
        for j, b in sets.items():
            if i != j:
                link = bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)
                n[i] += link
                assert link == (bool(a) and (cls[i] == cls[j] or (cls[i], cls[j]) in joined or (cls[j], cls[i]) in joined)), (i, j)
    assert {r.doc_id: (r.n_shingles, r.n_links) for r in members} == {i: (len(a), n[i]) for i, a in sets.items()}
    assert sum(n.values()) > 4 * len(rows) and links.count() == len(joined)
    members, links = ngram_jaccard_links(spark.createDataFrame([], "doc_id long, text string"), bits=16)
    assert members.count() == links.count() == 0


def test_rows_without_id_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (3, "A b c d e f")], "doc_id long, text string")
    assert sorted(map(str, ngram_jaccard_join(df, bits=16).collect())) == sorted(["Row(doc_id=None, n_shingles=2, component_id=None, n_links=0)", *["Row(doc_id=5, n_shingles=2, component_id=3, n_links=2)"] * 2, "Row(doc_id=3, n_shingles=2, component_id=3, n_links=2)"])
    assert ngram_jaccard_join(spark.createDataFrame([], "doc_id long, text string"), bits=16).count() == 0


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 102), (101, 102), (200, 201), (7, None)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(61)} | {(100, 100), (101, 100), (102, 100), (200, 200), (201, 200)}


def test_large_clusters_in_blocks(spark, monkeypatch):
    """Groups above every bound of a block, a tile and the all-pairs filter give what small ones give."""
    from scholium.llm import jaccard_join

    for name, value in (("FEW", 3), ("BLOCK_CLASSES", 4), ("TILE", 3), ("BLOCK_GRAMS", 700)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = corpus()
    got = jaccard_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bits=16)
    assert {tuple(r) for r in got.collect()} == brute(rows) and got.count() == len(rows)


def test_overlaps():
    rng = np.random.default_rng(1)
    x = [np.unique(rng.integers(0, 300, n, dtype=np.uint64)) for n in rng.integers(1, 90, 20)]
    y = [np.unique(rng.integers(0, 300, n, dtype=np.uint64)) for n in rng.integers(0, 90, 30)]
    for wide in (7, 1 << 16):
        assert overlaps(x, y, wide).tolist() == [[len(np.intersect1d(a, b)) for b in y] for a in x]
