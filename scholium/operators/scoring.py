"""Scores of cells (system, paper, field, score) and what leaderboards derive from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CORE = 10


def last_per_key(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Of repeated keys the value with the greatest ``order``; a hash aggregate, combined before the shuffle."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def field_means(cells: DataFrame) -> DataFrame:
    return cells.groupBy("system", "field").agg(F.avg("score").alias("mean"))


def composites(cells: DataFrame) -> DataFrame:
    """Mean over fields of the mean over papers; the same for core and other fields."""
    core = F.col("field") < CORE
    return field_means(cells).groupBy("system").agg(
        F.round(F.avg("mean"), 6).alias("composite"),
        F.round(F.avg(F.when(core, F.col("mean"))), 6).alias("core"),
        F.round(F.avg(F.when(~core, F.col("mean"))), 6).alias("other"),
    )


def leaderboard(cells: DataFrame) -> DataFrame:
    """Composites with rank, 1 and the number of strictly greater ones; taken over one row a system."""
    w = Window.orderBy(F.desc("composite"))
    return composites(cells).withColumn("position", F.rank().over(w)).withColumn("is_best", F.round("composite", 3) == F.max(F.round("composite", 3)).over(Window.partitionBy()))


def micro(cells: DataFrame) -> DataFrame:
    """Mean over cells for each system and tier, each system and all, in one pass of grouping sets."""
    tier = cells.withColumn("tier", F.when(F.col("field") < CORE, "core").otherwise("other"))
    return tier.rollup("system", "tier").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


def field_pivot(cells: DataFrame, systems: list[str]) -> DataFrame:
    """A row a field, a column a system."""
    wide = cells.groupBy("field").pivot("system", systems).agg(F.round(F.avg("score"), 6))
    return wide


def discordant(cells: DataFrame, right: float = 1.0) -> DataFrame:
    """McNemar counts of all pairs of systems over common cells, with the corrected chi square (|x - y| - 1)^2 / (x + y), 0 without
    discordant cells; right means a score of at least ``right``.

    The systems of a cell meet in one array, so cells move once; arrays are as long as there are systems.
    """
    marks = cells.groupBy("paper", "field").agg(F.array_sort(F.collect_list(F.struct("system", "score"))).alias("m"))
    one = marks.select(F.posexplode("m").alias("i", "a"), "m").select("a", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("b"))
    right_a, right_b = F.col("a.score") >= right, F.col("b.score") >= right
    n = one.groupBy(F.col("a.system").alias("system_a"), F.col("b.system").alias("system_b")).agg(
        F.count("*").alias("n"), F.count_if(right_a & ~right_b).alias("only_a"), F.count_if(~right_a & right_b).alias("only_b"), F.round(F.avg(F.col("a.score") - F.col("b.score")), 6).alias("delta")
    )
    x, y = F.col("only_a"), F.col("only_b")
    return n.withColumn("chi2", F.round(F.when(x + y == 0, 0.0).otherwise(F.pow(F.abs(x - y) - 1.0, F.lit(2.0)) / (x + y)), 6))


def bootstrap(cells: DataFrame, rounds: int = 2000, seed: int = 42) -> DataFrame:
    """Composite and its 95 % interval by drawing papers; sums of (paper, field) are all that a system's task holds."""

    def run(key, rows):
        import numpy as np
        import pandas as pd

        rows = rows.sort_values(["paper", "field"])
        paper, p = np.unique(rows["paper"], return_inverse=True)
        field, f = np.unique(rows["field"], return_inverse=True)
        total, count = np.zeros((len(paper), len(field))), np.zeros((len(paper), len(field)))
        np.add.at(total, (p, f), rows["score"].to_numpy())
        np.add.at(count, (p, f), 1)
        rng = np.random.default_rng(seed)
        stats = []
        for _ in range(rounds):
            weight = np.bincount(rng.integers(0, len(paper), len(paper)), minlength=len(paper))
            n = weight @ count
            stats.append(((weight @ total)[n > 0] / n[n > 0]).mean())
        low, high = np.percentile(stats, [2.5, 97.5])
        return pd.DataFrame({"system": [key[0]], "composite": [(total.sum(0) / count.sum(0)).mean()], "low": [low], "high": [high]})

    return cells.groupBy("system").applyInPandas(run, "system string, composite double, low double, high double")
