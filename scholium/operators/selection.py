"""Selection of a corpus: best of a key, anti overlap, splits, samples, bins and gap-filled counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_key(rows: DataFrame, key: str, rank: Column, keep: list[str]) -> DataFrame:
    """The row of greatest ``rank`` of each key, by a hash aggregate that combines before the shuffle."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*keep), rank).alias("best")).select(key, "best.*")


def hashed(key: str, salt: str) -> Column:
    """A stable order of rows that any engine can give: md5 of salt and key."""
    return F.md5(F.concat(F.lit(salt), F.col(key).cast("string")))


def stratified(rows: DataFrame, stratum: str, key: str, n: int, salt: str = "42") -> DataFrame:
    """The first n of each stratum by hash; a limit within groups, done before and after the shuffle."""
    w = Window.partitionBy(stratum).orderBy(hashed(key, salt), key)
    return rows.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= n)


def split(rows: DataFrame, key: str, salt: str = "split") -> DataFrame:
    """train, validation or test by the first two hex digits of the hash (80, 10 and 10 per cent); row-wise."""
    x = F.conv(F.substring(hashed(key, salt), 1, 4), 16, 10).cast("long") / 65536.0
    return rows.withColumn("part", F.when(x < 0.8, "train").when(x < 0.9, "validation").otherwise("test"))


def histogram(rows: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """Counts of [edge, next), the last closed, empty bins as zero."""
    last = len(edges) - 2
    chain = None
    for i in range(last + 1):
        inside = (value >= edges[i]) & ((value <= edges[i + 1]) if i == last else (value < edges[i + 1]))
        chain = (F if chain is None else chain).when(inside, i)
    counts = rows.select(chain.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("c"))
    bins = rows.sparkSession.range(last + 1).select(F.col("id").cast("int").alias("bin"))
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("c", F.lit(0)).cast("long").alias("n"))


def dense_years(rows: DataFrame, when: Column) -> DataFrame:
    """Rows of every year between the first and the last."""
    counts = rows.select(F.year(when).alias("year")).where("year is not null").groupBy("year").agg(F.count("*").alias("c"))
    span = counts.agg(F.min("year").alias("lo"), F.max("year").alias("hi")).where("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias("year"))
    return span.join(counts, "year", "left").select("year", F.coalesce("c", F.lit(0)).cast("long").alias("n"))


def domain_split(rows: DataFrame, domain: str, key: str, salt: str = "domain") -> DataFrame:
    """80/10/10 within each domain, at least one for test and validation; domains under three rows train only."""
    w = Window.partitionBy(domain)
    place = F.row_number().over(w.orderBy(hashed(key, salt), key))
    held = F.greatest(F.lit(1.0), F.bround(F.col("n") * 0.1, 0))
    r = rows.withColumn("n", F.count("*").over(w)).withColumn("i", place)
    part = F.when((F.col("n") < 3) | (F.col("i") > 2 * held), "train").when(F.col("i") <= held, "test").otherwise("validation")
    return r.withColumn("part", part).drop("n", "i")
