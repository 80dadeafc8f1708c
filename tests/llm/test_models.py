import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from scholium.llm import classifier, language
from scholium.llm import text as X
from scholium.llm.rows import remainder
from tests.llm import cases


def flat(texts):
    return X.flatten(pa.array(texts, pa.string()))


def junk_and_prose(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = cases.sentence(rng, rng.randrange(20, 200)).split()
        good = rng.random() < 0.8
        if not good:
            kind = rng.randrange(3)
            words = [w + rng.choice(["***", "$$$", "&&&"]) for w in words] if kind == 0 else [w.upper() + "!!" for w in words] if kind == 1 else [words[0]] * len(words)
        out.append((i, " ".join(words), int(good)))
    return out


def test_ranking_orders_held_out_documents(spark):
    rows = junk_and_prose(600)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    got = classifier.quality_ranking(docs, labels, remainder("doc_id", 5) == 0).collect()
    label = {i: q for i, _, q in rows}
    import zlib

    assert len(got) == 600 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    good, bad = [r.score for r in held if label[r.doc_id]], [r.score for r in held if not label[r.doc_id]]
    assert np.mean([g > b for g in good for b in bad]) > 0.98
    assert np.mean([r.predicted == label[r.doc_id] for r in held]) > 0.95


def test_ranking_edge_cases(spark):
    docs = cases.table(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = classifier.quality_ranking(docs, none, remainder("doc_id", 5) == 0)
    assert got.count() == len(cases.rows()) and got.where("score is null or isnan(score)").count() == 0
    some = spark.createDataFrame([(1, None), (None, 1), (4, 1), (7, 0), (10, 1), (13, 7)], "doc_id long, quality int")
    got = classifier.quality_ranking(docs.unionByName(docs), some, remainder("doc_id", 5) == 0)
    assert got.count() == 2 * len(cases.rows()) and got.where("score < 0 or score > 1 or isnan(score)").count() == 0
    assert classifier.quality_ranking(cases.empty(spark), some, remainder("doc_id", 5) == 0).count() == 0


def test_pair_likelihood_is_at_its_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(classifier.NAMES)))
    y = (x[:, 0] - 2 * x[:, 3] + rng.normal(size=400) > 0).astype(int)
    m = classifier.fit(x, y, pairs=20000)
    assert np.argmax(np.abs(m.w)) == 3 and m.w[0] > 0 > m.w[3]
    assert abs((m.score(x) < 0.3).mean() - (y == 0).mean()) < 0.02


def brute_phrases(train, text):
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in train:
            j += 1
        n, i = n + 1, j
    return n


def test_automata_parse_like_substring_search():
    rng = random.Random(4)
    train = {"a": "".join(rng.choice("abcd ") for _ in range(300)), "b": "".join(rng.choice("cdef ") for _ in range(200))}
    m = language.Model(train)
    texts = ["".join(rng.choice("abcdefz ") for _ in range(rng.randrange(0, 700))) for _ in range(20)]
    cps = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    offs = np.cumsum([0, *map(len, texts)])
    got = m.phrases(m.lut[cps], offs)
    for t, n in zip(texts, got, strict=True):
        for k, name in enumerate(m.languages):
            assert n[k] == sum(brute_phrases(train[name], t[i : i + language.SEGMENT]) for i in range(0, len(t), language.SEGMENT))


def test_scripts_of_many_characters(spark):
    rng = random.Random(12)
    zh, ja = [[chr(a + i) for i in range(0, 900, 3)] for a in (0x4E00, 0x4E01)]
    train = {"ja": "".join(rng.choice(ja) for _ in range(3000)), "zh": "".join(rng.choice(zh) for _ in range(3000)), "en": "".join(rng.choice("abcdefgh ") for _ in range(900))}
    m = language.Model(train)
    texts = ["".join(rng.choice(zh + ja + list("abcxyz ")) for _ in range(rng.randrange(0, 600))) for _ in range(12)]
    texts += [train["zh"][i : i + 300] + train["ja"][i : i + 40] for i in range(0, 900, 300)]
    got = m.phrases(m.lut[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)], np.cumsum([0, *map(len, texts)]))
    for t, n in zip(texts, got, strict=True):
        for k, name in enumerate(m.languages):
            assert n[k] == sum(brute_phrases(train[name], t[i : i + language.SEGMENT]) for i in range(0, len(t), language.SEGMENT))
    words = [["".join(rng.choice(x) for _ in range(2)) for _ in range(200)] for x in (zh, ja)]
    rows = [(i, "".join(rng.choice(words[i % 2]) for _ in range(20 if i % 3 else 45)), ("zh", "ja")[i % 2]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.language_of(docs, remainder("doc_id", 3) == 1).collect()
    held = [r.lang_pred == rows[r.doc_id][2] for r in got if r.held_out]
    assert len(held) > 60 and np.mean(held) > 0.98


def made_up(rng, letters, n):
    parts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 4))) for _ in range(40)]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_held_out_languages(spark):
    rng = random.Random(2)
    state = rng.getstate()
    rows = []
    makers = {}
    for name, letters in (("aa", "etaoinsh"), ("bb", "éàaoinsç"), ("cc", "хцзщшгнеку")):
        parts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 4))) for _ in range(40)]
        makers[name] = parts
    for i in range(240):
        name = ["aa", "bb", "cc"][i % 3] if i % 10 else "aa"
        rows.append((i, " ".join("".join(rng.choice(makers[name]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(15, 60))), name))
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !!! \n", "cc"), (1003, "xyz", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("s"))
    got = {r.doc_id: r for r in language.language_of(docs, remainder("doc_id", 3) == 1).collect()}
    held = [(i, lang) for i, _, lang in rows[:240] if got[i].held_out]
    assert len(held) > 50 and np.mean([got[i].lang_pred == lang for i, lang in held]) > 0.98
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002)) and got[1003].lang_pred in makers
    assert all(0 <= r.score <= 1 for r in got.values()) and state


def test_short_documents_fill_the_training_text(spark):
    rng = random.Random(8)
    rows = [(i, made_up(rng, "abcdefgh", 40)[:60].strip() if i % 2 else "12 3!? -- " * 30 + rng.choice("abcd") * 40, "aa" if i % 2 else "bb") for i in range(900)]
    m = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), chars=4000)
    assert m.languages == ["aa", "bb"] and [round(math.exp(x)) for x in m.norm] == [4000, 4000]


def test_language_edge_cases(spark):
    got = language.language_of(cases.table(spark), remainder("doc_id", 3) == 1)
    assert got.count() == len(cases.rows()) and got.where("lang_pred is null or score is null").count() == 0
    assert language.language_of(cases.empty(spark), remainder("doc_id", 3) == 1).count() == 0
    unlabelled = cases.table(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.language_of(unlabelled, remainder("doc_id", 3) == 1).collect()} == {"und"}


def plain_features(t):
    """What classifier.features gives, character by character and word by word."""
    import re

    import zstandard

    raw = t.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n, size = len(words), max(len(raw), 1)
    letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    symbol, plain = set(b"#*$%&|<>@^~=+_\\{}[]"), set(b".,;:'\"-!?()0123456789 \t\n\x0b\x0c\r")
    if not n:
        return [0.0] * 17 + [1.0]
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    lines, seen, dup = raw.split(b"\n"), set(), 0
    for line in lines:
        if re.search(rb"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(n - 4)]
    again = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    ups = [sum(65 <= c <= 90 for c in w) for w in words]
    letters = [sum(map(letter, w)) for w in words]
    ratio = len(raw) / len(zstandard.ZstdCompressor(level=1).compress(raw))
    return [
        sum(c in symbol for c in raw) / size, sum(any(c in symbol for c in w) for w in words) / n, sum(ups) / max(sum(letters), 1), sum(u >= 2 and u >= 0.5 * k for u, k in zip(ups, letters, strict=True)) / n,
        sum(48 <= c <= 57 for c in raw) / size, raw.count(b"!") / n, raw.count(b"|") / n, sum(not letter(c) and c not in plain for c in raw) / size, dup / len(lines), len(again) / n,
        math.log(len(set(low))) / math.log(n + 1), max(low.count(w) for w in set(low)) / n, math.log(max(ratio, 0.1)) - 0.12 * math.log(size), math.log(max(sum(len(w.decode()) for w in words), 1) / n),
        sum(len(w) > 40 for w in words) / n, math.log(n) / 10, sum(a == b for a, b in zip(low, low[1:], strict=False)) / n, 0.0,
    ]


def test_features_and_scores_by_hand():
    rng = random.Random(3)
    texts = [t if t is not None and len(t) < 4000 else "" for t in cases.texts()] + [t for _, t, _ in junk_and_prose(30)] + ["A\nA\nb b b!! | x1 ###", "same " * 9]
    rng.shuffle(texts)
    got = classifier.features(*flat(texts))
    want = np.array([plain_features(t) for t in texts])
    assert np.allclose(got, want, atol=1e-9), [(classifier.NAMES[j], texts[i][:40], got[i, j], want[i, j]) for i, j in zip(*np.nonzero(~np.isclose(got, want, atol=1e-9)), strict=True)][:5]
    y = (np.arange(len(texts)) % 3 > 0).astype(int)
    m = classifier.fit(got, y, pairs=5000)
    strength = [sum(w * min(8.0, max(-8.0, (x - a) / b)) for x, a, b, w in zip(row, m.mean, m.scale, m.w, strict=True)) for row in want]
    score = [1 / (1 + math.exp(-min(40.0, max(-40.0, (s - m.shift) * m.slope + math.log(0.3 / 0.7))))) for s in strength]
    assert np.allclose(m.score(got), score, atol=1e-6)
