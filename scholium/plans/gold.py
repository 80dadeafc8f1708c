"""Queries on systems, papers and fields. Parts are papers; a part's key deals gold values, answers and verdicts over its cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.catalogue import query, table
from scholium.functions import nulls
from scholium.operators import gold as G
from scholium.plans.values import GOLD_NULL, low

# (field, gold, record as JSON, verdict, score, way of scoring) of eight kinds of cells; the record's keys are prefixed or short
CASES = [
    ("sc:license", "MIT", '{"license": "The MIT License"}', None, 1.0, "exact_match"),
    ("sc:url", "https://a.org", '{"sc:url": null, "url": "a.org"}', None, 0.0, "missing"),
    ("sc:name", "[NULL - not found in paper]", '{"name": "X"}', None, 0.0, "hallucination"),
    ("sc:publisher", "Unknown", '{"url": "x"}', None, None, "correct_null"),
    ("rai:dataBiases", "some", '{"rai:dataBiases": "a few"}', 2, 0.5, "judge"),
    ("rai:dataUseCases", "many", '{"rai:dataUseCases": "all"}', None, None, "judge"),
    ("sc:creator", "Ann Lee", '{"creator": "Lee, Ann"}', None, 1.0, "token_f1"),
    ("rai:dataLimitations", "size", '{"rai:dataLimitations": ""}', 1, 0.0, "missing"),
]
SYSTEMS = 3


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Gold, answers, verdicts and split: each paper has one case, shifted by one for each system; system 2 lacks every fifth paper."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("paper"))
    n = len(CASES)

    def pick(i, shift):
        return F.element_at(F.array(*[F.lit(c[i]) for c in CASES]), (F.pmod(F.col("paper") + shift, F.lit(n)) + 1).cast("int"))

    gold = part.select("paper", pick(0, F.lit(0)).alias("field"), pick(1, F.lit(0)).alias("gold"), F.when(F.col("paper") % 6 == 5, "tie_split").otherwise("majority_2of3").alias("method"))
    systems = part.crossJoin(F.broadcast(spark.range(SYSTEMS).select(F.col("id").alias("system")))).where("not (system = 2 and paper % 5 = 0)")
    answers = systems.select("system", "paper", F.from_json(pick(2, F.lit(0)), "map<string,string>").alias("record"))
    first = systems.select("system", "paper", pick(0, F.lit(0)).alias("field"), pick(3, F.lit(0)).alias("verdict"), F.lit(2).alias("at"))
    older = first.withColumn("verdict", F.lit(3)).withColumn("at", F.lit(1)).where("verdict is not null and field = 'rai:dataBiases'")
    # another system's verdict and one that gives no score are not this cell's
    other = first.where("field = 'rai:dataUseCases'").withColumn("system", F.col("system") + 100).withColumn("verdict", F.lit(1))
    split = part.select("paper", F.when(F.col("paper") % 7 == 0, "dev").otherwise("test").alias("role"))
    return gold, answers, older.unionByName(first).unionByName(other), split


def scored(spark, sf_dir) -> DataFrame:
    gold, answers, verdicts, split = tables(spark, sf_dir)
    return G.cells(G.in_split(G.settled(gold), split, "test"), answers, verdicts)


ROWS = ", ".join(f"({i}, '{f}', {'NULL' if s is None else s}, '{m}')" for i, (f, _, _, _, s, m) in enumerate(CASES))
SCORED = f"""WITH k(i, field, score, metric) AS (VALUES {ROWS}),
    cells AS (SELECT s.range AS system, p_partkey AS paper, field, score::DOUBLE AS score, metric FROM part JOIN k ON i = p_partkey % {len(CASES)}, range({SYSTEMS}) s
        WHERE NOT (s.range = 2 AND p_partkey % 5 = 0) AND p_partkey % 6 <> 5 AND p_partkey % 7 <> 0)
"""


@query(SCORED + "SELECT system, paper, field, score, metric FROM cells")
def gold_cells(spark, sf_dir):
    return scored(spark, sf_dir).select("system", "paper", "field", "score", "metric")


@query(SCORED + """, f AS (SELECT system, field, avg(score) AS m FROM cells WHERE score IS NOT NULL GROUP BY ALL)
    SELECT c.*, round(macro, 6) AS macro, n_fields FROM (SELECT system, count(score) AS n_scored, count_if(score IS NULL)::BIGINT AS n_skipped, count_if(metric = 'correct_null')::BIGINT AS n_correct_null, count_if(metric = 'hallucination')::BIGINT AS n_hallucination,
        count_if(metric = 'missing')::BIGINT AS n_missing, count_if(metric = 'exact_match')::BIGINT AS n_exact_match, count_if(metric = 'token_f1')::BIGINT AS n_token_f1, count_if(metric = 'judge')::BIGINT AS n_judge, round(avg(score), 6) AS micro FROM cells GROUP BY system) c
    JOIN (SELECT system, avg(m) AS macro, count(*) AS n_fields FROM f GROUP BY system) USING (system)""")
def strategy_report(spark, sf_dir):
    return G.report(scored(spark, sf_dir))


@query(f"""SELECT s.range AS system, p_partkey AS paper, 'rai:dataUseCases' AS field FROM part, range({SYSTEMS}) s WHERE p_partkey % {len(CASES)} = 5 AND NOT (s.range = 2 AND p_partkey % 5 = 0)""")
def cells_to_judge(spark, sf_dir):
    gold, answers, verdicts, _ = tables(spark, sf_dir)
    return G.unjudged(gold, answers, verdicts)


@query(SCORED + "SELECT paper, field, system, metric FROM cells WHERE (paper, field) IN (SELECT paper, field FROM cells GROUP BY ALL HAVING count(DISTINCT system) = 3)")
def matched_cells(spark, sf_dir):
    return G.common_cells(scored(spark, sf_dir)).select("paper", "field", "system", "metric")


@query(SCORED + """, s AS (SELECT * FROM cells WHERE metric <> 'hallucination')
    SELECT system, field, round(avg(CASE WHEN metric <> 'correct_null' THEN (coalesce(score, 0) >= 0.8)::INT END), 6) AS strict, round(avg(CASE WHEN metric <> 'correct_null' THEN (coalesce(score, 0) >= 0.8)::INT ELSE 1 END), 6) AS lenient FROM s GROUP BY ALL""")
def strict_and_lenient(spark, sf_dir):
    return G.record_accuracy(scored(spark, sf_dir))


@query(SCORED + """, e AS (SELECT system, CASE WHEN metric = 'hallucination' THEN 'hallucination' WHEN metric = 'missing' THEN 'omission' WHEN score = 0 THEN 'wrong' WHEN score < 1 THEN 'partial' END AS error FROM cells),
    b AS (SELECT system, error, count(*) AS n FROM e WHERE error IS NOT NULL GROUP BY ALL)
    SELECT system, error, n, first_value(error) OVER (PARTITION BY system ORDER BY n DESC, error) AS dominant, sum(n) OVER (PARTITION BY system)::BIGINT AS errors FROM b""")
def error_taxonomy(spark, sf_dir):
    return G.error_taxonomy(scored(spark, sf_dir))


@query(SCORED + """, m AS (SELECT field, system, round(avg(score), 6) AS m FROM cells WHERE score IS NOT NULL GROUP BY ALL)
    SELECT DISTINCT field, round(avg(m) OVER (PARTITION BY field), 6) AS average, first_value(system) OVER (PARTITION BY field ORDER BY m DESC, system) AS best, max(m) OVER (PARTITION BY field) AS best_mean FROM m""")
def best_per_field(spark, sf_dir):
    return G.best_systems(scored(spark, sf_dir))


@query(SCORED + """SELECT system, paper, field, CASE WHEN paper % 10 = 0 THEN 1 ELSE score END::DOUBLE AS score FROM cells WHERE system < 2 OR paper % 10 <> 0
    UNION ALL SELECT 2, paper, field, 1 FROM cells WHERE system = 0 AND paper % 10 = 0""")
def overlay_rerun(spark, sf_dir):
    rows = scored(spark, sf_dir).select("system", "paper", "field", "score")
    newer = rows.where("system = 0 and paper % 10 = 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("system"), "paper", "field", F.lit(1.0).alias("score"))
    return G.overlaid(rows, newer, ["system", "paper", "field"])


@query(f"""WITH g AS (SELECT p_partkey, p_name AS gold, {low("p_name")} AS t FROM part) SELECT count(*) AS n, count_if({GOLD_NULL.format('t')})::BIGINT AS nulls FROM g""")
def gold_null_count(spark, sf_dir):
    return table(spark, sf_dir, "part").agg(F.count("*").alias("n"), F.count_if(nulls.gold_null(F.col("p_name"))).alias("nulls"))
