"""Queries on files, chats, runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholium.catalogue import query, table
from scholium.functions import sequences as Q
from scholium.sources import corpora as C


@query("""WITH t AS (SELECT * FROM conversations WHERE trim(coalesce(text, '')) <> '')
    SELECT conv_id, count(*)::INT AS turns, string_agg(role, ',' ORDER BY turn) AS roles, md5(string_agg(text, '|' ORDER BY turn)) AS digest FROM t GROUP BY conv_id""")
def chatml_export(spark, sf_dir):
    rows = C.chatml(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    m = F.col("messages")
    return rows.select("conv_id", F.size(m).alias("turns"), F.array_join(F.transform(m, lambda x: x["role"]), ",").alias("roles"), F.md5(F.array_join(F.transform(m, lambda x: x["content"]), "|")).alias("digest"))


@query("""WITH t AS (SELECT conv_id, list(role ORDER BY turn) AS r, bool_or(trim(coalesce(text, '')) = '') AS empty FROM conversations GROUP BY conv_id)
    SELECT conv_id, concat_ws(',', CASE WHEN len(list_filter(r, lambda x: x NOT IN ('system', 'user', 'assistant'))) > 0 THEN 'unknown role' END, CASE WHEN empty THEN 'empty turn' END,
        CASE WHEN coalesce(list_position(r, 'assistant'), 0) < coalesce(list_position(r, 'user'), 0) THEN 'answer before question' END) AS errors FROM t""")
def chat_errors(spark, sf_dir):
    by = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return by.select("conv_id", F.array_join(C.chat_errors(F.col("m")), ",").alias("errors"))


@query("SELECT l_orderkey, count(*) AS n, CASE WHEN max(c) * 2 > count(*) THEN max_by(v, c) ELSE NULL END IS NOT NULL AS majority FROM (SELECT l_orderkey, l_returnflag AS v, count(*) OVER (PARTITION BY l_orderkey, l_returnflag) AS c FROM lineitem) GROUP BY l_orderkey")
def majority_of_runs(spark, sf_dir):
    runs = table(spark, sf_dir, "lineitem")
    n = runs.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return Q.vote(runs, ["l_orderkey"], "l_linenumber", "l_returnflag").join(n, "l_orderkey").select("l_orderkey", "n", (F.col("votes") * 2 > F.col("n")).alias("majority"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def still_to_do(spark, sf_dir):
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return C.to_do(table(spark, sf_dir, "customer").select("c_custkey"), done, ["c_custkey"])


@query(None)
def sequence_similarity_pairs(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lead("text").over(w).alias("next")).where("text is not null and next is not null")
    return rows.select("conv_id", "turn", F.round(Q.ratio(F.col("text"), F.col("next")), 6).alias("ratio"), Q.alike(F.col("text"), F.col("next"), 0.4).alias("alike"))


@query(None)
def run_confidence(spark, sf_dir):
    return Q.field_confidence(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", "l_returnflag")
