import re

import corpus_pipeline as P
from tests.llm import cases
from tests.llm.test_jaccard_join import brute as groups


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def without_repeats(rows, k=50):
    first, out = {}, {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - k + 1):
            key = tuple(w[p : p + k])
            first[key] = min(i, first.get(key, i))
    for i, t in rows:
        w = words(t)
        gone = {q for p in range(len(w) - k + 1) if first[tuple(w[p : p + k])] < i for q in range(p, p + k)}
        out[i] = " ".join(x for p, x in enumerate(w) if p not in gone) if gone else t
    return out


def test_stages_take_effect_and_run_is_their_sequence(spark, tmp_path):
    docs = cases.table(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    steps = dict(P.STAGES)
    spoken = steps["language ID"](spark, docs, "").collect()
    assert {r["doc_id"] for r in spoken} == {i for i, t, *_ in cases.rows() if t and re.search(r"[^\W\d_]", t)}
    good = steps["quality rules"](spark, spark.createDataFrame(spoken, docs.schema), "").collect()
    assert {r["doc_id"] for r in good} < {r["doc_id"] for r in spoken} and good
    one = steps["n-gram Jaccard join"](spark, spark.createDataFrame(good, docs.schema), "").collect()
    assert {r["doc_id"] for r in one} == {i for i, _, root, _ in groups([(r["doc_id"], r["text"]) for r in good]) if i == root} and len(one) < len(good)
    cut = steps["substring dedup"](spark, spark.createDataFrame(one, docs.schema), "").collect()
    assert {r["doc_id"]: r["text"] for r in cut} == without_repeats([(r["doc_id"], r["text"]) for r in one])
    assert all(r["n_chars"] == len(r["text"]) for r in cut) and cut[0].__fields__ == docs.columns
    packed = steps["packing"](spark, spark.createDataFrame(cut, docs.schema), "").groupBy("doc_id").sum("length").collect()
    whole = P.run(spark, str(tmp_path)).groupBy("doc_id").sum("length").collect()
    assert sorted(packed) == sorted(whole) and len(whole) == len(cut)


def test_an_id_with_two_texts_is_two_documents(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (5, a), (5, b), (3, b + " more"), (9, a + " more"), (7, c), (None, a), (8, ""), (8, " ")]
    got = P.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(5, a), (3, b + " more"), (7, c), (None, a), (8, ""), (8, " ")]))


CLASH = ("lang_pred", "score", "kept", "n_words", "n_removed", "base_failed", "component_id", "id", "th", "d1", "rep", "size", "start", "length", "text2")


def test_stages_on_an_empty_table_and_with_names_that_clash(spark, tmp_path):
    from pyspark.sql import functions as F

    empty = cases.empty(spark)
    for name, stage in P.STAGES:
        got = stage(spark, empty, "")
        assert got.collect() == [], name
        assert name == "packing" or got.columns == empty.columns
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []
    plain = cases.table(spark)
    odd = plain
    for c in CLASH:
        odd = odd.withColumn(c, F.lit("mine"))
    for name, stage in P.STAGES[:-1]:
        a, b = stage(spark, plain, ""), stage(spark, odd, "")
        assert b.columns == odd.columns and sorted(map(str, b.select(*plain.columns).collect())) == sorted(map(str, a.collect())), name
        assert {r[0] for r in b.select(CLASH[0]).collect()} <= {"mine"} and {tuple(r) for r in b.select(*CLASH).distinct().collect()} == {("mine",) * len(CLASH)}, name


def test_stages_with_null_ids_and_repeated_rows(spark):
    rows = [(None, t, None, None, None) for _, t, *_ in cases.rows()[6:9]] + [r for r in cases.rows()[6:9] for _ in range(3)]
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    for name, stage in P.STAGES:
        got = stage(spark, docs, "").collect()
        assert got, name
        nulls = [r for r in got if r["doc_id"] is None]
        assert nulls, name  # a row without an id is a document of its own, in every stage
