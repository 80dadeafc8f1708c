"""Likeness of character sequences and agreement between runs.

Ratcliff and Obershelp's ratio is a recursion over longest common blocks, which no built-in expression has; it runs in
Arrow batches behind a bound of the lengths that settles most pairs without it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholium.functions.names import low, plain_text


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    """2 M / T of the plain texts, M characters in matching blocks of T in both."""
    return _ratio(plain_text(a), plain_text(b))


def alike(a: Column, b: Column, threshold: float = 0.8) -> Column:
    """Whether the ratio reaches a threshold; lengths too far apart cannot, whatever the characters."""
    x, y = plain_text(a), plain_text(b)
    n, m = F.length(x), F.length(y)
    possible = 2.0 * F.least(n, m) >= threshold * (n + m)
    return F.when(x == y, True).when(~possible, False).otherwise(_ratio(F.when(possible & (x != y), x), F.when(possible & (x != y), y)) >= threshold)


def runs_agree(a: Column, b: Column) -> Column:
    """Whether two runs gave the same: both nothing, equal texts, or alike ones if one is over 20 characters."""
    from scholium.functions.nulls import nullish

    x, y = low(F.coalesce(a, F.lit(""))), low(F.coalesce(b, F.lit("")))
    none = nullish(a).cast("int") + nullish(b).cast("int")
    long = F.greatest(F.length(x), F.length(y)) > 20
    return F.when(none == 2, True).when(none == 1, False).when(x == y, True).when(long, alike(a, b)).otherwise(False)


def field_confidence(runs: DataFrame, key: list[str], run: str, value: str) -> DataFrame:
    """(key, pairs, agreement, level): share of pairs of runs that agree, as high, medium or low. Runs of a key are few and meet in a join."""
    a, b = runs.select(*key, F.col(run).alias("i"), F.col(value).alias("a")), runs.select(*key, F.col(run).alias("j"), F.col(value).alias("b"))
    pairs = a.join(b, key).where("i < j").withColumn("same", runs_agree(F.col("a"), F.col("b")).cast("int"))
    by = pairs.groupBy(*key).agg(F.count("*").alias("pairs"), F.round(F.avg("same"), 6).alias("agreement"))
    return by.withColumn("level", F.when(F.col("agreement") >= 0.8, "high").when(F.col("agreement") >= 0.5, "medium").otherwise("low"))


def vote(runs: DataFrame, key: list[str], run: str, value: str) -> DataFrame:
    """(key, winner, votes): the value that more than half of the runs gave, as first written, else the longest one there is."""
    has = runs.where(F.trim(F.coalesce(value, F.lit(""))) != "").withColumn("__v", low(F.col(value)))
    n = runs.groupBy(*key).agg(F.count("*").alias("n"))
    by = has.groupBy(*key, "__v").agg(F.count("*").alias("c"), F.min_by(value, run).alias("first"))
    best = by.groupBy(*key).agg(F.max_by(F.struct("c", "first"), F.struct(F.col("c"), F.length("first"), F.col("__v"))).alias("top"), F.max_by("first", F.struct(F.length("first"), F.col("__v"))).alias("longest"))
    return n.join(best, key, "left").select(*key, F.when(F.col("top.c") * 2 > F.col("n"), F.col("top.first")).otherwise(F.col("longest")).alias("winner"), F.coalesce("top.c", F.lit(0)).alias("votes"))
