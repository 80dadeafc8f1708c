import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholium.llm.knn import voronoi_top_k, wanted

SCHEMA = "vec_id long, embedding array<float>, label string"


def brute(rows, m, k):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in ok:
        if i % m == 0:
            best = sorted({(-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ok if j != i})[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("clash")).repartition(3)


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 3, (6, 8))
    rows = [(i, [float(x) for x in centres[min(5, i % 9)] + rng.normal(0, 0.3, 8)], "x") for i in range(400)]
    rows += [(1000 + i, rows[7][1], None) for i in range(20)]  # ties
    rows += [(2000, None, "x"), (None, rows[0][1], "x"), (2010, [1.0] * 7 + [float("nan")], "x"), (2020, [1.0] * 7 + [float("inf")], "x"), (2030, [1.0] * 7 + [None], "x"), (2040, [0.0] * 8, "x")]
    want = brute(rows, 10, 5)
    for chunk in (50, 10_000):
        got = voronoi_top_k(table(spark, rows), F.col("vec_id") % 10 == 0, chunk=chunk)
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def ranked_by_id(rows, m, k):
    """As the SQL has it: one ranking for each query id, over all of its vectors."""
    v = {(i, tuple(math.floor(256 * x) for x in v)) for i, v, _ in rows}
    pairs = {}
    for i, q in v:
        if i % m == 0:
            pairs.setdefault(i, set()).update((-sum(a * b for a, b in zip(q, x, strict=True)), j) for j, x in v if j != i)
    return {(i, r + 1, j, -s) for i, p in pairs.items() for r, (s, j) in enumerate(sorted(p)[:k])}


def test_repeated_ids_do_not_crowd_out_others(spark):
    rows = [(0, [1.0, 0.0], None), *[(7, [9.0, 0.0], None)] * 6, *[(i, [float(8 - i), 0.0], None) for i in range(1, 6)]]
    got = {tuple(r) for r in voronoi_top_k(table(spark, rows), F.col("vec_id") == 0).collect()}
    assert got == brute(rows, 10, 5) and [v for _, _, v, _ in sorted(got)] == [7, 1, 2, 3, 4]
    # one id under many vectors: of equal scores, of the query's own id, and over many cells
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 3)], None) for i in list(range(60)) + [7] * 40 + [10] * 40 + [20] * 15]
    rows += [(7, [3.0, float(y), 0.0], None) for y in range(12)] + [(0, [1.0, 0.0, 0.0], None)] * 9
    for chunk in (20, 10_000):
        out = [tuple(r) for r in voronoi_top_k(table(spark, rows), F.col("vec_id") % 10 == 0, chunk=chunk).collect()]
        assert sorted(out) == sorted(ranked_by_id(rows, 10, 5))


def test_few_rows_and_empty_table(spark):
    rows = [(0, [1.0, 2.0], None), (1, [3.0, 1.0], None), (2, [3.0, 1.0], None)]
    assert {tuple(r) for r in voronoi_top_k(table(spark, rows), F.col("vec_id") % 10 == 0).collect()} == brute(rows, 10, 5)
    assert voronoi_top_k(table(spark, []), F.col("vec_id") % 10 == 0).collect() == []


def test_bounds_leave_cells_out_but_none_that_is_needed():
    rng = np.random.default_rng(8)
    pivots = rng.normal(0, 50, (20, 6))
    cell = np.repeat(np.arange(20), 30)
    x = pivots[cell] + rng.normal(0, 1, (600, 6))
    far = np.sqrt(((x - pivots[cell]) ** 2).sum(1)).reshape(20, 30)
    need = wanted(x[::7], pivots, np.full(20, 30), far.min(1), far.max(1), 5)
    assert need.mean() < 0.7
    for q, n in zip(x[::7], need, strict=True):
        assert n[cell[np.argsort(-(x @ q))[:6]]].all()


def test_vectors_of_different_lengths_raise(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0], None) for i in range(50)] + [(60, [1.0, 2.0, 3.0], None), (61, [1.0, 2.0, 3.0, 4.0, 5.0], None)]
    with pytest.raises(Exception, match="different lengths"):
        voronoi_top_k(table(spark, rows), F.col("vec_id") % 10 == 0).collect()


def test_one_pivot_and_many_give_the_same(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 4)], None) for i in range(300)] + [(5, [9.0, 9.0, 9.0, 9.0], None)] * 8
    got = [sorted(tuple(r) for r in voronoi_top_k(table(spark, rows), F.col("vec_id") % 10 == 0, pivots=p, chunk=50).collect()) for p in (1, 7, None)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 150
