"""Queries that sum up runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholium.catalogue import CELLS, cells, query, table
from scholium.operators import reports as R
from scholium.plans.values import dealt

LABELLED = [("sc:publisher", "ICLR 2021", "ICLR", 2), ("sc:publisher", "ICLR", "ICLR 2021", 1), ("sc:license", "MIT", "MIT License", 1), ("sc:datePublished", "2016-02-23", "in 2016", 1), ("sc:name", "SQuAD", "GLUE", 3), ("sc:url", "https://a.org/x", "a.org", 2), ("sc:creator", "Ann Lee", "ann lee", 1), ("rai:dataBiases", "many kinds of bias", "some bias", 3), ("rai:dataBiases", "a bias", "the bias", 2), ("sc:url", "x", "[null]", 3), ("sc:url", "", "x", None)]


@query("SELECT p_partkey, ([" + ", ".join("NULL" if x[3] is None else str(x[3]) for x in LABELLED) + f"])[1 + p_partkey % {len(LABELLED)}]::INT AS label FROM part")
def true_labels(spark, sf_dir):
    field, gold, answer = (dealt([x[i] for x in LABELLED], "p_partkey") for i in range(3))
    return table(spark, sf_dir, "part").select("p_partkey", R.true_label(field, gold, answer).alias("label"))


@query(CELLS + ", m AS (SELECT system, field, avg(score) AS m FROM cells GROUP BY ALL) SELECT system, round(avg(m) FILTER (field < 10), 6) AS core, round(avg(m) FILTER (field >= 10), 6) AS other FROM m GROUP BY system")
def tier_pivot(spark, sf_dir):
    return R.tier_pivot(cells(spark, sf_dir), F.when(F.col("field") < 10, "core").otherwise("other"), ["core", "other"])


@query("""WITH v AS (SELECT p_partkey, p_size / 50.0 AS a, CASE WHEN p_partkey % 3 > 0 THEN (p_partkey % 50) / 50.0 END AS b, CASE WHEN p_partkey % 4 > 0 THEN length(p_name) / 50.0 END AS c FROM part),
    w AS (SELECT *, greatest(a, b, c) AS best FROM v) SELECT p_partkey, CASE WHEN (abs(a - best) < 0.01)::INT + coalesce((abs(b - best) < 0.01)::INT, 0) + coalesce((abs(c - best) < 0.01)::INT, 0) > 1 THEN 'Tie' WHEN a = best THEN 'Paper' WHEN b = best THEN 'Card' ELSE 'Combined' END AS best FROM w""")
def source_winner(spark, sf_dir):
    k = F.col("p_partkey")
    scores = {"Paper": F.col("p_size") / 50.0, "Card": F.when(k % 3 > 0, (k % 50) / 50.0), "Combined": F.when(k % 4 > 0, F.length("p_name") / 50.0)}
    return table(spark, sf_dir, "part").select("p_partkey", R.best_source(scores).alias("best"))


@query("""WITH v AS (SELECT lang, source, length(coalesce(text, '')) > 500 AS f FROM documents) SELECT source, round(100 * avg(f::INT) FILTER (lang = 'en'), 6) AS en, round(100 * avg(f::INT) FILTER (lang = 'fr'), 6) AS fr, round(100 * avg(f::INT), 6) AS overall FROM v GROUP BY source""")
def fill_rate_splits(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", "source", (F.length(F.coalesce("text", F.lit(""))) > 500).alias("f"))
    return R.fill_rates(rows, "lang", "source", "f", ["en", "fr"])


@query("""WITH r AS (SELECT unnest([{'column': 'text', 'rate': avg((trim(coalesce(text, ''), E' \\t\\n\\r\\x0b\\x0c') = '')::INT)}, {'column': 'lang', 'rate': avg((trim(coalesce(lang, '')) = '')::INT)}, {'column': 'source', 'rate': avg((trim(coalesce(source, '')) = '')::INT)}]) AS x FROM documents)
    SELECT x."column" AS "column", round(x.rate, 6) AS rate FROM r ORDER BY rate DESC, "column" LIMIT 2""")
def null_rate_top(spark, sf_dir):
    return R.null_rates(table(spark, sf_dir, "documents"), ["text", "lang", "source"], 2)


@query("""SELECT 'l_quantity' AS "column", count_if(l_quantity < 5)::BIGINT AS below, count_if(l_quantity > 45)::BIGINT AS above, count_if(l_quantity IS NULL)::BIGINT AS missing FROM lineitem
    UNION ALL SELECT 'l_discount', count_if(l_discount < 0.01)::BIGINT, count_if(l_discount > 0.05)::BIGINT, count_if(l_discount IS NULL)::BIGINT FROM lineitem""")
def range_checks(spark, sf_dir):
    return R.out_of_range(table(spark, sf_dir, "lineitem"), {"l_quantity": (5, 45), "l_discount": (0.01, 0.05)})


@query("""WITH a AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE year(o_orderdate) < 1996 GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE year(o_orderdate) > 1993 GROUP BY 1)
    SELECT count_if(a.k IS NOT NULL AND b.k IS NOT NULL)::BIGINT AS n_common, count_if(a.v = b.v)::BIGINT AS n_same, count_if(b.k IS NULL)::BIGINT AS n_only_old, count_if(a.k IS NULL)::BIGINT AS n_only_new FROM a FULL JOIN b USING (k)""")
def coverage_compared(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    part = lambda c: rows.where(c).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v"))
    return R.compared(part("year(o_orderdate) < 1996"), part("year(o_orderdate) > 1993"), ["k"], "v")


@query("""SELECT l_orderkey, CASE min(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END) WHEN 1 THEN 'A' WHEN 2 THEN 'R' ELSE 'N' END AS label, count(*) AS annotators FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_orderkey""")
def priority_labels(spark, sf_dir):
    return R.priority_label(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", ["A", "R", "N"])


@query("""SELECT count_if(l_returnflag <> 'N')::BIGINT AS n, count_if(l_returnflag = 'N')::BIGINT AS n_skipped, count_if(l_returnflag = 'A')::BIGINT AS n_a, count_if(l_returnflag = 'R')::BIGINT AS n_r, round(avg(CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'R' THEN 0.5 END), 6) AS mean FROM lineitem""")
def evaluator_stats(spark, sf_dir):
    return R.evaluator_stats(table(spark, sf_dir, "lineitem"), "l_returnflag", {"A": 1.0, "R": 0.5}, "N")


@query("""WITH c AS (SELECT conv_id, turn, contains(lower(coalesce(text, '')), 'the')::INT + contains(lower(coalesce(text, '')), 'you')::INT AS hits, contains(lower(role), 'assist') OR contains('assist', lower(role)) AS near FROM conversations),
    p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY hits DESC, turn) AS place FROM c WHERE hits > 0 OR near),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN place <= 5 AND hits > 0 THEN place ELSE 1000000 + turn END) AS rank FROM p WHERE near OR (place <= 5 AND hits > 0))
    SELECT conv_id, turn AS chunk, rank::INT AS rank, hits::INT AS hits FROM o WHERE rank <= 8""")
def chunk_retrieval(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.coalesce("text", F.lit("")).alias("text"), F.col("role").alias("section"), F.col("turn").alias("chunk"))
    return R.retrieved(rows, "conv_id", ["the", "You"], ["assist"])


@query("""WITH e AS (SELECT l_orderkey AS k, l_linenumber AS o, l_returnflag AS f, l_partkey AS v, l_quantity < 10 AS n FROM lineitem), m AS (SELECT k, f, coalesce(max(o) FILTER (n), -1) AS cut FROM e GROUP BY ALL),
    s AS (SELECT k, f, min_by(v, (o, v)) AS v FROM e JOIN m USING (k, f) WHERE NOT n AND o > cut GROUP BY ALL) SELECT m.k, m.f, s.v FROM m LEFT JOIN s USING (k, f)""")
def agent_state(spark, sf_dir):
    events = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("o"), F.col("l_returnflag").alias("f"), F.col("l_partkey").alias("v"), F.when(F.col("l_quantity") < 10, "null").otherwise("set").alias("a"))
    return R.agent_state(events, "k", "o", "f", "v", "a")


@query("""SELECT p_partkey, CASE WHEN j = 'likely' AND h > 0 THEN 'PRESENT' WHEN j = 'unlikely' AND (h = 0 OR c >= 0.8) THEN 'ABSENT' ELSE 'IMPLICIT' END AS presence, round(p_size * 0.0035, 4)::DOUBLE AS budget, p_partkey % 4 <> 0 AS fine
    FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'likely' WHEN 1 THEN 'unlikely' ELSE 'unknown' END AS j, p_size % 5 AS h, (p_partkey % 10) / 10.0 AS c FROM part)""")
def triage_and_budget(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").withColumn("errors", F.create_map(F.lit("g"), F.when(k % 4 == 0, "HTTP 429 quota").otherwise("none")))
    fine = R.without_errors(rows, "errors", ["429", "timeout"]).select("p_partkey", F.lit(True).alias("ok"))
    judged = F.when(k % 3 == 0, "likely").when(k % 3 == 1, "unlikely").otherwise("unknown")
    return rows.join(fine, "p_partkey", "left").select("p_partkey", R.presence(F.col("p_size") % 5, judged, (k % 10) / 10.0).alias("presence"), R.judge_budget(F.col("p_size"), F.lit(2.5), F.lit(10.0)).alias("budget"), F.coalesce("ok", F.lit(False)).alias("fine"))
