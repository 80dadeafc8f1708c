"""Agreement, correlation and multiple testing from aggregated counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_ranks(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Average ranks with ties, from a table of distinct values: only that is sorted in one place."""
    counts = rows.groupBy(value).agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.join(counts.select(value, (upto - (F.col("__n") - 1) / 2.0).alias(out)), value)


def correlations(rows: DataFrame, x: str, y: str) -> DataFrame:
    ranked = average_ranks(average_ranks(rows, x, "rx"), y, "ry")
    return ranked.agg(F.count("*").alias("n"), F.round(F.corr(x, y), 6).alias("pearson"), F.round(F.corr("rx", "ry"), 6).alias("spearman"))


def quadratic_kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """1 - sum d^2 observed / sum d^2 expected, from moments: no matrix is built."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    seen = F.avg((x - y) * (x - y))
    chance = F.avg(x * x) + F.avg(y * y) - 2 * F.avg(x) * F.avg(y)
    return rows.agg(F.count("*").alias("n"), F.round(1 - seen / chance, 6).alias("kappa"))


def vote_counts(votes: DataFrame, unit: str, value: str) -> DataFrame:
    return votes.where(F.col(value).isNotNull()).groupBy(unit, value).agg(F.count("*").alias("c"))


def krippendorff_nominal(votes: DataFrame, unit: str, value: str) -> DataFrame:
    """From counts of values in units; units of one vote do not count."""
    c = vote_counts(votes, unit, value)
    c = c.join(c.groupBy(unit).agg(F.sum("c").alias("m")).where("m > 1"), unit)
    by = c.groupBy(value).agg(F.sum("c").alias("nv"), F.sum(F.col("c") * (F.col("m") - F.col("c")) / (F.col("m") - 1)).alias("off"))
    total = by.agg(F.sum("nv").alias("n"), F.sum("off").alias("off"), F.sum(F.col("nv") * F.col("nv")).alias("sq"))
    return total.select("n", F.round(1 - (F.col("n") - 1) * F.col("off") / (F.col("n") * F.col("n") - F.col("sq")), 6).alias("alpha"))


def majority(votes: DataFrame, unit: str, value: str) -> DataFrame:
    """Most frequent value of each unit; none where two share the place (``tie``) or there are under two votes."""
    c = vote_counts(votes, unit, value)
    best = c.groupBy(unit).agg(F.max(F.struct(F.col("c"))).alias("top"), F.sum("c").alias("n_votes"))
    both = c.join(best, unit).where(F.col("c") == F.col("top.c"))
    return both.groupBy(unit).agg(F.when((F.count("*") == 1) & (F.first("n_votes") > 1), F.min(value)).alias("winner"), F.first("n_votes").alias("n_votes"), F.max("c").alias("n_winner"), (F.count("*") > 1).alias("tie"))


# A rational form of erfc, good to 1.2e-7.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0; erfc(sqrt(c / 2)) is the tail of chi square with one degree of freedom."""
    t = 1.0 / (1.0 + 0.5 * x)
    inner = F.lit(0.0)
    for c in reversed(ERFC):
        inner = c + t * inner
    return t * F.exp(-x * x + inner)


def normal_p(z: Column) -> Column:
    """Two-sided p value of a normal score."""
    return F.least(F.lit(1.0), erfc(F.abs(z) / 2**0.5))


def benjamini_hochberg(tests: DataFrame, p: str, order: list[str]) -> DataFrame:
    """q values by the cumulative minimum from the greatest p; tests are few (pairs of systems)."""
    up = Window.orderBy(p, *order)
    ranked = tests.withColumn("place", F.row_number().over(up)).withColumn("m", F.count("*").over(Window.partitionBy()))
    down = Window.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("q", F.min(F.col(p) * F.col("m") / F.col("place")).over(down))


def pareto(rows: DataFrame, cost: str, gain: str, order: str) -> DataFrame:
    """Whether no row of at most the same cost gains as much; rows are few (systems)."""
    before = Window.orderBy(cost, F.desc(gain), order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("on_front", F.coalesce(F.col(gain) > F.max(gain).over(before), F.lit(True)))


def crosstab(rows: DataFrame, a: str, b: str, values: list[str]) -> DataFrame:
    """A row a value of ``a``: counts and row percentages of ``b``."""
    cells: list[Column] = [F.count_if(F.col(b) == v).alias(f"n_{v}") for v in values]
    return rows.groupBy(a).agg(F.count("*").alias("n"), *cells).select(a, "n", *[c for v in values for c in (F.col(f"n_{v}"), F.round(100 * F.col(f"n_{v}") / F.col("n"), 6).alias(f"pct_{v}"))])


def fleiss(votes: DataFrame, unit: str, value: str, raters: int) -> DataFrame:
    """Fleiss' kappa over the units that have exactly ``raters`` votes."""
    c = vote_counts(votes, unit, value)
    c = c.join(c.groupBy(unit).agg(F.sum("c").alias("m")).where(F.col("m") == raters), unit)
    by = c.groupBy(value).agg(F.sum("c").alias("nv"), F.sum(F.col("c") * F.col("c")).alias("sq"))
    t = by.agg(F.sum("nv").alias("all"), F.sum("sq").alias("sq"), F.sum(F.col("nv").cast("double") * F.col("nv")).alias("chance"))
    seen, chance = (F.col("sq") - F.col("all")) / (F.col("all") * (raters - 1)), F.col("chance") / (F.col("all") * F.col("all"))
    return t.select((F.col("all") / raters).cast("long").alias("units"), F.round(F.when(chance == 1, 1.0).otherwise((seen - chance) / (1 - chance)), 6).alias("kappa"))


def wilcoxon(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Signed ranks of a - b without zeros: n, both rank sums and z by the normal form with tie correction."""
    d = pairs.select((F.col(a) - F.col(b)).alias("d")).where("d <> 0").withColumn("size", F.abs("d"))
    by = d.groupBy("size").agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("up"))
    upto = F.sum("t").over(Window.orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    r = by.withColumn("rank", upto - (F.col("t") - 1) / 2.0)
    s = r.agg(F.sum("t").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * (F.col("t") - F.col("up"))).alias("w_minus"), F.sum(F.pow(F.col("t").cast("double"), 3.0) - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    z = (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return s.select("n", "w_plus", "w_minus", F.round(z, 6).alias("z"))


def distribution(rows: DataFrame, value: str) -> DataFrame:
    """Least, mean, exact median and 95th percentile (linear), greatest."""
    return rows.agg(F.min(value).alias("low"), F.round(F.avg(value), 6).alias("mean"), F.round(F.percentile(value, 0.5), 6).alias("p50"), F.round(F.percentile(value, 0.95), 6).alias("p95"), F.max(value).alias("high"))


def confusion(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of all pairs of ratings with their distance."""
    return rows.groupBy(a, b).agg(F.count("*").alias("n")).withColumn("off_by", F.abs(F.col(a) - F.col(b)))
