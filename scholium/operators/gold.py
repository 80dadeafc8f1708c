"""Answers of systems against gold: cells, reports, overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.functions import fields as S
from scholium.functions import nulls
from scholium.functions.scalars import verdict_score

# Methods by which a gold value counts as settled.
SETTLED = ["unanimous_3of3", "unanimous_4of4", "majority_2of3", "majority_3of4", "adjudicated", "tie_resolved_via_correction"]


def settled(gold: DataFrame, methods: list[str] = SETTLED) -> DataFrame:
    return gold.where(F.col("method").isin(methods))


def in_split(rows: DataFrame, split: DataFrame, role: str | None = None) -> DataFrame:
    """Rows of the papers of a split; without a role, of all papers in it."""
    return rows.join(split.where(F.col("role") == role) if role else split, "paper", "left_semi")


def last_verdicts(verdicts: DataFrame) -> DataFrame:
    """(system, paper, field, judged): of repeated verdicts the last that gives a score."""
    return verdicts.where("verdict is not null").groupBy("system", "paper", "field").agg(verdict_score(F.max_by("verdict", "at")).alias("judged"))


def cells(gold: DataFrame, answers: DataFrame, verdicts: DataFrame, null_rule=nulls.gold_null, correct_null: str = "drop") -> DataFrame:
    """(system, paper, field, score, metric) for each gold cell and each system that answered the paper.

    ``gold``: paper, field, gold. ``answers``: system, paper, record (a map, fields prefixed or short); a paper without a record
    has no cell. ``verdicts`` as for :func:`last_verdicts`; a long text without one has no score. Gold meets answers on the
    paper and verdicts on the cell: two equi joins, no file is read twice.
    """
    both = gold.join(answers, "paper").withColumn("answer", S.resolved(F.col("record"), F.col("field")))
    both = both.join(last_verdicts(verdicts), ["system", "paper", "field"], "left")
    found = S.score(F.col("field"), F.col("answer"), F.col("gold"), F.col("judged"), null_rule, correct_null)
    return both.withColumn("s", found).select("system", "paper", "field", "gold", "answer", "s.score", "s.metric")


def proxy_cells(gold: DataFrame, answers: DataFrame) -> DataFrame:
    """Cells without verdicts: token F1 stands for them, and gold without a value is left out whatever the answer."""
    both = gold.where(~nulls.field_null(F.col("gold"))).join(answers, "paper").withColumn("answer", S.resolved(F.col("record"), F.col("field"), canonical=False))
    f1 = S.S.token_f1(S.tokens(F.col("answer")), S.tokens(F.col("gold")))
    s = S.score(F.col("field"), F.col("answer"), F.col("gold"), f1)
    return both.select("system", "paper", "field", s["score"].alias("score"))


def report(cells: DataFrame) -> DataFrame:
    """Per system: cells with and without a score, each way of scoring, and both composites."""
    counts = [F.count_if(F.col("metric") == m).alias(f"n_{m}") for m in ("correct_null", "hallucination", "missing", "exact_match", "token_f1", "judge")]
    per = cells.groupBy("system").agg(F.count("score").alias("n_scored"), F.count_if(F.col("score").isNull()).alias("n_skipped"), *counts, F.round(F.avg("score"), 6).alias("micro"))
    macro = cells.where("score is not null").groupBy("system", "field").agg(F.avg("score").alias("m")).groupBy("system").agg(F.round(F.avg("m"), 6).alias("macro"), F.count("*").alias("n_fields"))
    return per.join(macro, "system", "left")


def unjudged(gold: DataFrame, answers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Cells that still need a verdict: long texts with gold and answer, less those that have one."""
    both = gold.where(S.kind(F.col("field")) == "rai").where(~nulls.gold_null(F.col("gold"))).join(answers, "paper")
    both = both.where(~nulls.blank(S.resolved(F.col("record"), F.col("field")))).select("system", "paper", "field")
    return both.join(verdicts.where("verdict is not null"), ["system", "paper", "field"], "left_anti")


def overlaid(rows: DataFrame, newer: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with those of equal keys replaced by ``newer``, which also adds its own."""
    return rows.join(newer, keys, "left_anti").unionByName(newer)


def common_cells(cells: DataFrame) -> DataFrame:
    """Cells that every system has: counts and a semi join, whatever the number of systems."""
    n = cells.agg(F.count_distinct("system").alias("n_systems"))
    shared = cells.groupBy("paper", "field").agg(F.count_distinct("system").alias("n")).join(F.broadcast(n), F.col("n") == F.col("n_systems"))
    return cells.join(shared, ["paper", "field"], "left_semi")


def record_accuracy(cells: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Share of cells with gold whose score reaches a threshold, strict (only cells with gold) and lenient (correct nulls count as right)."""
    has = F.col("metric") != "correct_null"
    scored = cells.where(~F.col("metric").isin("hallucination"))
    return scored.groupBy("system", "field").agg(
        F.round(F.avg(F.when(has, (F.coalesce("score", F.lit(0.0)) >= threshold).cast("int"))), 6).alias("strict"),
        F.round(F.avg(F.when(has, (F.coalesce("score", F.lit(0.0)) >= threshold).cast("int")).otherwise(1)), 6).alias("lenient"),
    )


def error_taxonomy(cells: DataFrame) -> DataFrame:
    """Per system the errors by type, and the commonest type (equal ones: the first in order)."""
    error = F.when(F.col("metric") == "hallucination", "hallucination").when(F.col("metric") == "missing", "omission").when(F.col("score") == 0, "wrong").when(F.col("score") < 1, "partial")
    by = cells.withColumn("error", error).where("error is not null").groupBy("system", "error").agg(F.count("*").alias("n"))
    top = by.groupBy("system").agg(F.min_by("error", F.struct(-F.col("n"), F.col("error"))).alias("dominant"), F.sum("n").alias("errors"))
    return by.join(top, "system")


def best_systems(cells: DataFrame) -> DataFrame:
    """Per field the mean of all systems' means and the best system (equal ones: the first in order)."""
    per = cells.where("score is not null").groupBy("field", "system").agg(F.round(F.avg("score"), 6).alias("m"))
    return per.groupBy("field").agg(F.round(F.avg("m"), 6).alias("average"), F.min_by("system", F.struct(-F.col("m"), F.col("system"))).alias("best"), F.max("m").alias("best_mean"))
