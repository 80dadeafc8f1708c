"""n-gram overlap of items with a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.functions import scalars as S

SIZES = (8, 13, 25)


def _words(text: Column) -> Column:
    """Hashes of a text's words, from which the n-grams' are made without writing them out."""
    return F.transform(S.gram_words(text), lambda w: F.xxhash64(w))


def _hashes(words: Column, n: int) -> Column:
    """Two hashes, of 64 and 32 bits, of the n-gram of every place."""
    return F.transform(S.slices(words, n), lambda g: F.struct(F.xxhash64(g).alias("h1"), F.hash(g).alias("h2")))


def _items(items: DataFrame, item_id: str, sizes: tuple[int, ...]) -> DataFrame:
    words = items.select(item_id, _words(F.col("text")).alias("w"))

    def of(n):
        return F.transform(_hashes(F.col("w"), n), lambda h: F.struct(F.lit(n).alias("n"), h["h1"].alias("h1"), h["h2"].alias("h2")))

    return words.select(item_id, F.explode(F.flatten(F.array(*map(of, sizes)))).alias("g")).select(item_id, "g.*").distinct()


def overlap(items: DataFrame, corpus: DataFrame, item_id: str, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """Share of each item's distinct n-grams that some corpus text has; items without n-grams are left out.

    A longer n-gram that an item has begins with a shortest one that it has. So of the corpus only the shortest n-grams are
    hashed everywhere; they meet those of the items (the optimizer broadcasts these where it knows them to be small), and the longer
    ones are built only where one was met, in the few texts that have such places.
    """
    base = min(sizes)
    mine = _items(items, item_id, sizes)
    wanted = mine.where(F.col("n") == base).select("h1", "h2").distinct()
    short = corpus.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("d"), _words(F.col("text")).alias("w"))
    places = short.select("d", F.posexplode(_hashes(F.col("w"), base)).alias("at", "g")).select("d", "at", "g.h1", "g.h2")
    hits = places.join(wanted, ["h1", "h2"], "left_semi")
    by_text = hits.groupBy("d").agg(F.collect_set("at").alias("places"))
    long = [n for n in sizes if n != base]
    met = hits.select(F.lit(base).alias("n"), "h1", "h2")
    if long:
        again = corpus.where(F.col("text").isNotNull()).withColumn("d", F.xxhash64("text")).join(by_text, "d").select("places", _words(F.col("text")).alias("w"))

        def grown(n):
            fits = F.filter("places", lambda i: i + n <= F.size("w"))
            return F.transform(fits, lambda i: F.struct(F.lit(n).alias("n"), F.xxhash64(F.slice("w", i + 1, n)).alias("h1"), F.hash(F.slice("w", i + 1, n)).alias("h2")))

        met = met.unionByName(again.select(F.explode(F.flatten(F.array(*map(grown, long)))).alias("g")).select("g.*"))
    both = mine.join(met.distinct().withColumn("hit", F.lit(1)), ["n", "h1", "h2"], "left")
    return both.groupBy(item_id, "n").agg(F.count("*").alias("n_grams"), F.count("hit").alias("n_hits"), F.round(F.count("hit") / F.count("*"), 4).alias("overlap"))


def summary(overlaps: DataFrame) -> DataFrame:
    return overlaps.groupBy("n").agg(F.count_if(F.col("n_hits") > 0).alias("items_hit"), F.count("*").alias("items"), F.max("overlap").alias("max_overlap"), F.round(F.avg("overlap"), 6).alias("mean_overlap"))
