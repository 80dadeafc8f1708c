import math
import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from scholium.llm.rows import remainder
from scholium.llm.suffix_tree import suffix_tree_scores
from tests.llm import cases

ALPHA, LEAST, GAIN = 10.0, 8, 2.0


def brute(rows):
    def split(t):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]

    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    after = defaultdict(Counter)
    for (_, t), h in zip(rows, held, strict=True):
        w = split(t)
        for p in range(len(w)) if not h else ():
            for d in range(min(p, 2) + 1):
                after[tuple(w[p - d : p])][w[p]] += 1
    root = after[()]
    n, v = sum(root.values()), len(root)
    kept = {()}

    def p(ctx, w, less=0):
        if not ctx:
            return (root[w] + 0.1) / (n + 0.1 * (v + 1))
        c = after[ctx]
        return (c[w] - less + ALPHA * p(ctx[1:], w)) / (sum(c.values()) - less + ALPHA)

    for d in (1, 2):
        for ctx, c in list(after.items()):
            if len(ctx) == d and ctx[1:] in kept and sum(c.values()) >= LEAST and sum(k * math.log(p(ctx, w, 1) / p(ctx[1:], w)) for w, k in c.items()) > GAIN:
                kept.add(ctx)
    out = []
    for (i, t), h in zip(rows, held, strict=True):
        w = split(t)
        score = 0
        for at in range(len(w)):
            ctx = next(tuple(w[at - d : at]) for d in (2, 1, 0) if d <= at and tuple(w[at - d : at]) in kept)
            score += math.log10(p(ctx, w[at]))
        out.append((str(i), h, len(w), sum(root[x] > 0 for x in w), n, sum(math.log10(p((), x)) for x in w), score))
    return sorted(out), len(kept)


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9)


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, t) for i, t, *_ in cases.rows()] + [(None, "a b c")]
    for i in range(200):
        # every third word follows from the two before it
        w = []
        for p in range(rng.randrange(1, 80)):
            w.append(f"f{w[-1]}{w[-2]}"[:6] if p % 3 == 2 else rng.choice("abcdefgh"))
        rows.append((1000 + i, " ".join(w)))
    want, kept = brute(rows)
    assert kept > 20
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(4)
    for hot in (1 << 17, 16, 0):
        got = suffix_tree_scores(df, remainder("doc_id", 10) == 0, hot=hot)
        same(sorted((str(r[0]), *r[1:]) for r in got.collect()), want)


def deep(rows):
    """Scores of the whole tree, and how deep it is."""
    texts = [t.split() + [None] for _, t in rows]
    after = defaultdict(Counter)
    for w, (i, _) in zip(texts, rows, strict=True):
        for p in range(len(w)) if zlib.crc32(str(i).encode()) % 10 else ():
            for d in range(min(p, 12) + 1):
                after[tuple(w[p - d : p])][w[p]] += 1
    root = after[()]
    n, v = sum(root.values()), len(root)
    total = {c: sum(x.values()) for c, x in after.items()}

    def p(ctx, w, less=0):
        return (after[ctx][w] - less + ALPHA * p(ctx[1:], w)) / (total[ctx] - less + ALPHA) if ctx else (root[w] + 0.1) / (n + 0.1 * (v + 1))

    kept = {()}
    for ctx in sorted(list(after), key=len):
        if ctx and ctx[1:] in kept and total[ctx] >= LEAST and sum(k * math.log(p(ctx, w, 1) / p(ctx[1:], w)) for w, k in after[ctx].items()) > GAIN:
            kept.add(ctx)
    out = {}
    for w, (i, _) in zip(texts, rows, strict=True):
        longest = [max((c for d in range(min(at, 12) + 1) if (c := tuple(w[at - d : at])) in kept), key=len) for at in range(len(w))]
        out[i] = sum(math.log10(p(c, x)) for c, x in zip(longest, w, strict=True))
    return out, max(map(len, kept)), kept


def test_contexts_are_as_long_as_the_test_of_divergence_lets_them(spark):
    rng = random.Random(6)
    rows = []
    for i in range(250):
        # every fifth word follows from the four before it; some passages come again
        w = []
        for at in range(rng.randrange(5, 60)):
            w.append("xy"[zlib.crc32(" ".join(w[-4:]).encode()) % 2] if at % 5 == 4 else rng.choice("abc"))
        rows.append((i, " ".join(w + (["in", "the", "end", "the", "same", "the", "end"] if i % 3 else []))))
    want, depth, kept = deep(rows)
    assert 4 <= depth < 12 and any(len(c) > 2 and c[1:-1] not in kept for c in kept)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for hot in (1 << 17, 0):
        got = {r.doc_id: r.score for r in suffix_tree_scores(df, remainder("doc_id", 10) == 0, hot=hot, depth=None).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def test_nothing_to_learn_from_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in suffix_tree_scores(df, F.lit(True)).collect()) == [(1, True, 3, 0, 0, 0.0, 0.0), (2, True, 1, 0, 0, 0.0, 0.0)]
    assert suffix_tree_scores(cases.empty(spark), F.lit(False)).collect() == []


def test_texts_are_read_once_and_little_is_written(spark, monkeypatch):
    from pathlib import Path

    from scholium.llm import suffix_tree
    from scholium.llm.shared import shared_dir

    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(3000)]
    rows = [(i, " ".join(vocabulary[int(3000 * rng.random() ** 4)] for _ in range(1000))) for i in range(300)]
    size, read, written = sum(len(t) for _, t in rows), spark.sparkContext.accumulator(0), []

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    def stored():
        return sum(p.stat().st_size for p in Path(shared_dir(spark).removeprefix("file:").replace("//", "/")).rglob("*.parquet"))

    before = stored()
    monkeypatch.setattr(suffix_tree, "materialize", lambda df, name, f=suffix_tree.materialize: (f(df, name), written.append(stored() - before))[0])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).mapInArrow(counted, "doc_id long, text string")
    assert suffix_tree_scores(df, remainder("doc_id", 10) == 0, depth=None).count() == len(rows)
    assert read.value == len(rows) and max(written) < size


def test_grams_behind_a_very_frequent_word_go_to_many_tasks(spark, monkeypatch, tmp_path):
    from scholium.llm import suffix_tree

    rng = random.Random(4)
    rows = [(i, " ".join(x for _ in range(60) for x in ("of", f"w{int(900 * rng.random() ** 2)}"))) for i in range(240)]
    want, kept = brute(rows)
    assert kept > 20

    def tested(level, *more, f=suffix_tree._tested):
        run = f(level, *more)

        def noted(table):
            (tmp_path / f"{level}-{table.column('part')[0]}").write_text(str(sum(len(suffix_tree._opened(x, "<u4")) for x in table.column("c").to_pylist())))
            return run(table)

        return noted

    monkeypatch.setattr(suffix_tree, "_tested", tested)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    same(sorted((str(r[0]), *r[1:]) for r in suffix_tree_scores(df, remainder("doc_id", 10) == 0).collect()), want)
    sizes = [int(p.read_text()) for p in tmp_path.glob("1-*")]
    assert max(sizes) < 0.25 * sum(sizes)
