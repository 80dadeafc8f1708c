"""Queries on selections, counts, sets and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholium.catalogue import CELLS, cells, query, table
from scholium.operators import corpus as C
from scholium.operators import scoring as P

DOMAIN = "CASE " + " ".join("WHEN regexp_matches(d, '" + "|".join(ws) + f"') THEN '{n}'" for n, ws in C.DOMAINS) + " ELSE 'Uncategorized' END"
WORDED = ["a photo set", "code of the repository", "Math word problems", "SPEECH and text", "clinical notes", "chart multi-modal", "cross-lingual data", "reading comprehension", "a benchmark", "satellite", "robot arm", "sentiment", "nothing of it", ""]
LIST = "([" + ", ".join(f"'{w}'" for w in WORDED) + f"])[1 + p_partkey % {len(WORDED)}]"


def worded():
    return F.element_at(F.array(*map(F.lit, WORDED)), (F.pmod("p_partkey", F.lit(len(WORDED))) + 1).cast("int"))


@query(f"SELECT domain, count(*) AS n FROM (SELECT {DOMAIN} AS domain FROM (SELECT lower({LIST}) AS d FROM part)) GROUP BY domain")
def domain_cascade(spark, sf_dir):
    return table(spark, sf_dir, "part").select(C.domain_of_text(worded()).alias("domain")).groupBy("domain").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Vision' WHEN 1 THEN 'NLP' WHEN 2 THEN 'Other' ELSE 'Audio' END AS domain FROM part")
def domain_of_tasks(spark, sf_dir):
    tasks = [["object-detection", "translation", "depth-estimation"], ["summarization", "object-detection", "unheard"], ["unheard"], ["text-to-speech", "translation"]]
    pick = F.element_at(F.array(*[F.array(*map(F.lit, t)) for t in tasks]), (F.pmod("p_partkey", F.lit(4)) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", C.domain_of_tasks(pick).alias("domain"))


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY md5('42' || doc_id), doc_id) AS turn FROM documents),
    p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY turn, source) AS place FROM t WHERE turn <= 12) SELECT lang, source, doc_id, place::INT AS place FROM p WHERE place <= 12""")
def round_robin_sample(spark, sf_dir):
    return C.round_robin(table(spark, sf_dir, "documents"), "lang", "source", "doc_id", 12).select("lang", "source", "doc_id", "place")


@query("""WITH p AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('sets' || doc_id), doc_id) AS place, CASE quality WHEN 0 THEN 13 ELSE 8 END AS n FROM labels WHERE quality IS NOT NULL)
    SELECT doc_id, quality, CASE WHEN place <= n THEN 'calibration' ELSE 'validation' END AS part FROM p WHERE place <= 2 * n""")
def calibration_sets(spark, sf_dir):
    return C.disjoint_sets(table(spark, sf_dir, "labels").where("quality is not null"), "quality", "doc_id", {"0": 13, "1": 8}).select("doc_id", "quality", "part")


@query("""WITH p AS (SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS place, count(*) OVER () AS n FROM part)
    SELECT p_partkey, place::INT AS place FROM p WHERE place IN (SELECT round_even(i * (n - 1) / 9.0, 0)::BIGINT FROM range(10) r(i), (SELECT count(*) AS n FROM part))""")
def diversity_pick(spark, sf_dir):
    return C.spread(table(spark, sf_dir, "part"), "p_retailprice", "p_partkey", 10).select("p_partkey", "place")


@query("""WITH chosen AS (SELECT p_partkey AS k, p_brand AS d FROM part WHERE p_size <= 25), pool AS (SELECT p_partkey AS k, p_brand AS d FROM part), c AS (SELECT d, count(*) AS c FROM chosen GROUP BY d),
    rare AS (SELECT d FROM c WHERE c < (SELECT avg(c) FROM c)), more AS (SELECT k, d FROM pool WHERE d IN (SELECT d FROM rare) AND k NOT IN (SELECT k FROM chosen) ORDER BY md5('more' || k), k LIMIT 20),
    big AS (SELECT d FROM c ORDER BY c DESC, d LIMIT 1), l AS (SELECT k, row_number() OVER (ORDER BY md5('less' || k), k) AS r FROM chosen WHERE d IN (SELECT d FROM big))
    SELECT k, d FROM chosen WHERE k NOT IN (SELECT k FROM l WHERE r <= (SELECT count(*) FROM more)) UNION ALL SELECT k, d FROM more""")
def top_n_rebalanced(spark, sf_dir):
    pool = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("d"), "p_size")
    return C.rebalanced(pool.where("p_size <= 25").drop("p_size"), pool.drop("p_size"), "d", "k")


@query("""WITH a AS (SELECT o_custkey, o_orderdate, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_orderdate) AS r FROM orders), b AS (SELECT *, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey, o_custkey) AS q FROM a WHERE r = 1)
    SELECT o_custkey, o_orderdate::DATE AS o_orderdate, o_orderkey FROM b WHERE q = 1""")
def one_to_one(spark, sf_dir):
    return C.one_to_one(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey").withColumn("o_orderdate", F.to_date("o_orderdate"))


@query("""WITH p AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS t, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS b FROM part)
    SELECT p_brand, p_partkey, t::INT AS place, 'top' AS "end" FROM p WHERE t <= 2 UNION ALL SELECT p_brand, p_partkey, b::INT, 'bottom' FROM p WHERE b <= 2""")
def top_and_bottom(spark, sf_dir):
    return C.ends(table(spark, sf_dir, "part").select("p_brand", "p_retailprice", "p_partkey"), "p_brand", "p_retailprice", "p_partkey", 2).select("p_brand", "p_partkey", "place", "end")


@query("SELECT value, count(*) AS n FROM (SELECT trim(unnest(string_split(p_name, ' '))) AS value FROM part) WHERE value <> '' GROUP BY value ORDER BY n DESC, value LIMIT 15")
def multi_value_counts(spark, sf_dir):
    return C.multi_values(table(spark, sf_dir, "part"), "p_name", " ", 15)


@query("""WITH p AS (SELECT doc_id, lang, source, (length(text) > 1000)::INT + (text LIKE '%the%')::INT AS n FROM documents WHERE text IS NOT NULL)
    SELECT lang, count(*) AS papers, round(avg(n), 6) AS mean, min(n)::BIGINT AS least, max(n)::BIGINT AS most, min_by(doc_id, (-n, doc_id)) AS fullest FROM p GROUP BY lang""")
def populated_per_group(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "lang", F.explode(F.array(F.length("text") > 1000, F.col("text").contains("the"))).alias("filled"))
    return C.populated(rows, "doc_id", "filled", ["lang"])


@query("""WITH d AS (SELECT * FROM (VALUES (0, 'A'), (1, 'N'), (2, 'R'), (3, 'X')) v(place, category)) SELECT place::INT AS place, category, count(l_returnflag) AS n FROM d LEFT JOIN lineitem ON l_returnflag = category GROUP BY ALL""")
def ratings_in_order(spark, sf_dir):
    return C.zero_filled(table(spark, sf_dir, "lineitem"), "l_returnflag", ["A", "N", "R", "X"])


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE l_returnflag END AS label FROM lineitem")
def failure_labels(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.labelled(F.col("l_returnflag"), {"a": "accepted", "r": "returned"}).alias("label"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'AB' WHEN 1 THEN 'BD' WHEN 2 THEN 'BDE' WHEN 3 THEN 'BC' WHEN 4 THEN 'C' ELSE '' END AS reasons FROM part""")
def null_audit_categories(spark, sf_dir):
    values = ["N/A", "---", "{}", "see the appendix", "we could not find any of the details that you asked for", "the annotators were hired by a company"]
    v = F.element_at(F.array(*map(F.lit, values)), (F.pmod("p_partkey", F.lit(6)) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", C.audit(v, ["could not", "appendix"]).alias("reasons"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'CC BY-NC' WHEN 1 THEN 'CC BY-SA' WHEN 2 THEN 'CC BY' WHEN 3 THEN 'CC0' WHEN 4 THEN 'MIT' ELSE 'Other' END AS family,
    CASE WHEN p_brand LIKE 'Brand#1%' THEN 'First' WHEN p_brand LIKE 'Brand#2%' THEN 'Second' ELSE 'Single-pass' END AS design FROM part""")
def plot_buckets(spark, sf_dir):
    v = F.element_at(F.array(*map(F.lit, ["cc-by-nc-4.0", "CC BY-SA", "CC-BY 4.0", "public domain", "permitted", "none"])), (F.pmod("p_partkey", F.lit(6)) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", C.family(v).alias("family"), C.architecture(F.col("p_brand"), [("Brand#1", "First"), ("Brand#2", "Second")]).alias("design"))


@query(CELLS + "SELECT system, composite, 'ranked' AS role FROM comp WHERE contains(lower(system), 'i')")
def leaderboard_search(spark, sf_dir):
    board = P.composites(cells(spark, sf_dir)).select("system", "composite", F.lit("ranked").alias("role"))
    return C.shown(board, "I", {"role": "ranked"})


@query(CELLS + "SELECT count_if(composite > 0.5) + 1 AS rank FROM comp")
def newcomer_rank(spark, sf_dir):
    return C.newcomer_rank(P.composites(cells(spark, sf_dir)), 0.5)


@query("""SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)) AS n_both, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS n_first,
    (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS n_second""")
def set_parts(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return C.split_of(a, a, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS x FROM documents), l AS (SELECT doc_id FROM labels WHERE quality = 0), s AS (SELECT max(c) > 0.6 * sum(c) AS over FROM (SELECT count(*) AS c FROM d GROUP BY lang))
    SELECT 'overlap' AS "check", n = 0 AS passed, n::BIGINT AS detail FROM (SELECT count(*) AS n FROM d WHERE doc_id IN (SELECT doc_id FROM l))
    UNION ALL SELECT 'repeats', count(*) = count(DISTINCT doc_id), (count(*) - count(DISTINCT doc_id))::BIGINT FROM d
    UNION ALL SELECT 'short', count_if(length(x) < 100) = 0, count_if(length(x) < 100)::BIGINT FROM d
    UNION ALL SELECT 'garbage', count_if(b) = 0, count_if(b)::BIGINT FROM (SELECT length(regexp_replace(x[1:1000], '[^\\x20-\\x7E\\s]', '', 'g')) / greatest(1, length(x[1:1000])) < 0.5 AND x <> '' AS b FROM d)
    UNION ALL SELECT 'domain share', NOT over, over::BIGINT FROM s""")
def selection_checks(spark, sf_dir):
    return C.selection_checks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 0").select("doc_id"), "doc_id", "lang", "text")


@query("SELECT 'org/' || p_partkey AS id FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 5 <> 1")
def known_left_out(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("org/"), k).alias("id"), F.array(F.concat(F.lit("p"), k), F.when(k % 7 == 0, "q").otherwise(F.concat(F.lit("r"), k))).alias("papers"), k.alias("k"))
    gold = rows.where("k % 5 = 0").select(F.regexp_replace("id", "/", "_").alias("id"), F.array(F.lit("q")).alias("papers")).unionByName(rows.where("k % 5 = 1").select("id", F.array().cast("array<string>").alias("papers")))
    return C.without_known(rows, gold, "id", "papers").select("id")


PRICED = """WITH c AS (SELECT role AS system, conv_id AS paper, CASE WHEN turn % 2 = 0 THEN 'main' ELSE 'triage' END AS part, (length(coalesce(text, '')) // 4)::BIGINT AS t, turn > 6 AS failed, turn FROM conversations),
    p AS (SELECT *, round((t * 3.0 + 100 * 15.0 + 50 * 0.3 + 10 * 3.75) / 1e6 * CASE WHEN turn % 3 = 0 THEN 0.5 ELSE 1 END, 4) AS cost FROM c)
"""


def priced(spark, sf_dir):
    t = F.floor(F.length(F.coalesce("text", F.lit(""))) / 4)
    cost = C.price(t, F.lit(100), F.lit(3.0), F.lit(15.0), F.col("turn") % 3 == 0, F.lit(50), F.lit(10), F.lit(0.3), F.lit(3.75))
    return table(spark, sf_dir, "conversations").select(F.col("role").alias("system"), F.col("conv_id").alias("paper"), F.when(F.col("turn") % 2 == 0, "main").otherwise("triage").alias("role"), cost.alias("cost"), (F.col("turn") > 6).alias("failed"))


@query(PRICED + """, s AS (SELECT system, paper, sum(cost) AS cost, bool_or(failed) AS failed, sum(CASE WHEN part = 'main' THEN cost END) AS main, sum(CASE WHEN part = 'triage' THEN cost END) AS triage FROM p GROUP BY ALL)
    SELECT system, round(avg(CASE WHEN NOT failed THEN cost END), 6) AS mean_cost, count_if(failed)::BIGINT AS failed_papers, round(avg(CASE WHEN NOT failed THEN main END), 6) AS mean_main, round(avg(CASE WHEN NOT failed THEN triage END), 6) AS mean_triage FROM s GROUP BY system""")
def cost_per_system(spark, sf_dir):
    return C.system_costs(priced(spark, sf_dir))
