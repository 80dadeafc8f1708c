"""Verdicts as a stream: the same rules as for tables, with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.functions.scalars import verdict_score
from scholium.operators.scoring import composites, last_per_key


def verdict_stream(spark, path: str, schema: str) -> DataFrame:
    """New Parquet files of verdicts (system, paper, field, verdict, scored_at) as they come."""
    return spark.readStream.schema(schema).parquet(path)


def once(verdicts: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each verdict once, as a judge's job may be repeated; state goes when the watermark has passed."""
    return verdicts.withWatermark("scored_at", late).dropDuplicatesWithinWatermark(["system", "paper", "field", "verdict"])


def rates(verdicts: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Per window and system the number of verdicts and their mean score."""
    rows = verdicts.withWatermark("scored_at", late)
    by = rows.groupBy(F.window("scored_at", window).alias("w"), "system").agg(F.count("verdict").alias("n"), F.avg(verdict_score(F.col("verdict"))).alias("mean"))
    return by.select(F.col("w.start").alias("start"), "system", "n", "mean")


def leaderboard_writer(cells: str, board: str):
    """For ``foreachBatch``: folds a batch into the table of last verdicts and writes the leaderboard of all.

    A batch that is run again, as after a lost executor, is written under its own number and so gives the same tables.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{cells}/{number - 1}"
        rows = batch.select("system", "paper", "field", "verdict", "scored_at")
        if number:
            rows = spark.read.parquet(before).unionByName(rows)
        packed = rows.withColumn("row", F.struct("verdict", "scored_at"))
        last = last_per_key(packed, ["system", "paper", "field"], "row", "scored_at").select("system", "paper", "field", "row.*")
        last.write.mode("overwrite").parquet(f"{cells}/{number}")
        scored = spark.read.parquet(f"{cells}/{number}").select("system", "paper", "field", verdict_score(F.col("verdict")).alias("score"))
        composites(scored).write.mode("overwrite").parquet(board)

    return fold
