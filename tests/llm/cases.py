"""Texts that every operator must stand: null, empty, white space, repeats, ties, odd code points, a very long one."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def sentence(rng, n, pool=400):
    return " ".join(rng.choice("the of and in to".split()) if rng.random() < 0.3 else "w" + str(rng.randrange(pool)) for _ in range(n))


def texts(seed=7):
    rng = random.Random(seed)
    base = sentence(rng, 300)
    shared = sentence(rng, 70, 10**6)
    near = base.split()
    near[10], near[200] = "changed", "also"
    return [
        None, "", "   \n\t ", "one", "One TWO three four", "a b c d e", base, base, " ".join(near), base + " " + sentence(rng, 10),
        sentence(rng, 40) + " " + shared + " " + sentence(rng, 40), shared, sentence(rng, 9, 10**6) + " " + shared, "Don't they'll we've I'm 's ''s  x  \n\n y\r\n z ",
        "naïve Ünïcode ÀÉ 日本語テキスト Ωμέγα ΣΑΣ ǅ İstanbul é  nb sp \U0001f600\U0001f601 ½ ² ١٢٣", "*** $$$ ### | <b> & %", "line one\nline one\nline one\n\n\nother\r\nline one", ("the same line\n" * 60),
        "ab " * 3000, sentence(rng, 20000, 5000), "x" * 5000, "word " + "y" * 70000 + " end", sentence(rng, 300), "\x00\x1c\x1d\x85 ctrl \x0b\x0c", "123 456 7890 3.14 1,000", "ALL CAPS HERE!! AND THERE!!",
    ]


def rows(seed=7):
    out = [(3 * i + 1, t, ["en", "fr", None][i % 3], f"src{i % 2}", len(t or "")) for i, t in enumerate(texts(seed))]
    return out


def table(spark, seed=7, parts=3):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
