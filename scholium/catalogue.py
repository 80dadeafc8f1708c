"""All queries of the library on the driver's tables, with the SQL that each is held against.

Roles of the tables: an event is a judged cell (system = event_type, paper = user_id, field = props.k modulo 30, verdict
from value), documents are papers, order lines are votes, conversations are pairs of texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholium.functions import scalars as S
from scholium.operators import contamination as C
from scholium.operators import records as R
from scholium.operators import scoring as P
from scholium.operators import selection as X
from scholium.operators import statistics as T
from scholium.operators import texts as D

QUERIES: dict = {}
ORACLE_SQL: dict = {}
FLAGSHIP = "leaderboard_rank"


def query(sql: str | None = None):
    """Registers a query under the function's name, with its SQL."""

    def put(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLE_SQL[run.__name__] = sql
        return run

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    verdict = F.when(F.col("value") < 5, 3).when(F.col("value") < 20, 2).otherwise(1)
    field = F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(30))
    rows = events.select(F.col("event_type").alias("system"), F.col("user_id").alias("paper"), field.alias("field"), S.verdict_score(verdict).alias("score"), "event_id")
    return P.last_per_key(rows, ["system", "paper", "field"], "score", "event_id")


CELLS = """
    WITH cells AS (SELECT event_type AS system, user_id AS paper, json_extract_string(props, '$.k')::INT % 30 AS field,
        arg_max(CASE WHEN value < 5 THEN 0.0 WHEN value < 20 THEN 0.5 ELSE 1.0 END::DOUBLE, event_id) AS score FROM events GROUP BY ALL),
    means AS (SELECT system, field, avg(score) AS mean FROM cells GROUP BY ALL),
    comp AS (SELECT system, round(avg(mean), 6) AS composite, round(avg(mean) FILTER (field < 10), 6) AS core,
        round(avg(mean) FILTER (field >= 10), 6) AS other FROM means GROUP BY system)
"""
SYSTEMS = ("click", "error", "purchase", "signup", "view")


@query(CELLS + "SELECT * FROM cells")
def cell_scores(spark, sf_dir):
    return cells(spark, sf_dir)


@query(CELLS + "SELECT * FROM comp")
def composite_macro(spark, sf_dir):
    return P.composites(cells(spark, sf_dir))


@query(CELLS + "SELECT *, rank() OVER (ORDER BY composite DESC)::INT AS position, round(composite, 3) = max(round(composite, 3)) OVER () AS is_best FROM comp")
def leaderboard_rank(spark, sf_dir):
    return P.leaderboard(cells(spark, sf_dir))


@query(CELLS + """SELECT system, tier, count(*) AS n, round(avg(score), 6) AS mean
    FROM (SELECT *, CASE WHEN field < 10 THEN 'core' ELSE 'other' END AS tier FROM cells) GROUP BY ROLLUP (system, tier)""")
def composite_micro(spark, sf_dir):
    return P.micro(cells(spark, sf_dir))


@query(CELLS + "SELECT field, " + ", ".join(f"round(avg(score) FILTER (system = '{s}'), 6) AS {s}" for s in SYSTEMS) + " FROM cells GROUP BY field")
def per_field_pivot(spark, sf_dir):
    return P.field_pivot(cells(spark, sf_dir), list(SYSTEMS))


PAIRS = CELLS + """, pairs AS (SELECT a.system AS system_a, b.system AS system_b, count(*) AS n,
        count_if(a.score = 1 AND b.score < 1) AS only_a, count_if(a.score < 1 AND b.score = 1) AS only_b, round(avg(a.score - b.score), 6) AS delta
        FROM cells a JOIN cells b USING (paper, field) WHERE a.system < b.system GROUP BY ALL),
    tests AS (SELECT *, round(CASE WHEN only_a + only_b = 0 THEN 0 ELSE (abs(only_a - only_b) - 1)::DOUBLE ** 2 / (only_a + only_b) END, 6) AS chi2 FROM pairs)
"""


@query(PAIRS + "SELECT system_a, system_b, n, only_a::BIGINT AS only_a, only_b::BIGINT AS only_b, delta, chi2 FROM tests")
def pairwise_mcnemar(spark, sf_dir):
    return P.discordant(cells(spark, sf_dir))


@query(PAIRS + """, r AS (SELECT *, t * exp(-chi2 / 2 - 1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807
        + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277))))))))) AS p FROM (SELECT *, 1 / (1 + 0.5 * sqrt(chi2 / 2)) AS t FROM tests)),
    s AS (SELECT *, row_number() OVER (ORDER BY p, system_a, system_b) AS place, count(*) OVER () AS m FROM r)
    SELECT system_a, system_b, round(min(p * m / place) OVER (ORDER BY place DESC ROWS UNBOUNDED PRECEDING), 6) AS q FROM s""")
def bh_fdr(spark, sf_dir):
    tests = P.discordant(cells(spark, sf_dir)).withColumn("p", T.erfc(F.sqrt(F.col("chi2") / 2)))
    return T.benjamini_hochberg(tests, "p", ["system_a", "system_b"]).select("system_a", "system_b", F.round("q", 6).alias("q"))


@query(CELLS + """, c AS (SELECT system, composite, n FROM comp JOIN (SELECT event_type AS system, round(sum(value), 2) AS n FROM events GROUP BY 1) USING (system))
    SELECT system, composite, n AS cost, coalesce(composite > max(composite) OVER (ORDER BY n, composite DESC, system ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS on_front FROM c""")
def pareto_frontier(spark, sf_dir):
    cost = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("system")).agg(F.round(F.sum("value"), 2).alias("cost"))
    rows = P.composites(cells(spark, sf_dir)).select("system", "composite").join(cost, "system")
    return T.pareto(rows, "cost", "composite", "system")


@query()
def bootstrap_composite_ci(spark, sf_dir):
    return P.bootstrap(cells(spark, sf_dir))


GRAMS = """
    WITH w AS (SELECT 'i' AS kind, item_id AS id, text FROM benchmark UNION ALL SELECT 'd', doc_id, text FROM documents),
    t AS (SELECT kind, id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM w),
    s AS (SELECT kind, id, n, ws, unnest(range(1, len(ws) - n + 2)) AS p FROM t, (VALUES (8), (13), (25)) AS v(n) WHERE len(ws) >= n),
    g AS (SELECT DISTINCT kind, id, n, array_to_string(ws[p:p+n-1], ' ') AS g FROM s),
    c AS (SELECT DISTINCT n, g, 1 AS hit FROM g WHERE kind = 'd'),
    o AS (SELECT id AS item_id, n::INT AS n, count(*) AS n_grams, count(hit) AS n_hits, round(count(hit) / count(*), 4) AS overlap
          FROM (SELECT * FROM g WHERE kind = 'i') LEFT JOIN c USING (n, g) GROUP BY ALL)
"""


@query(GRAMS + "SELECT * FROM o")
def contamination_overlap(spark, sf_dir):
    return C.overlap(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id")


@query(GRAMS + "SELECT n, count_if(n_hits > 0)::BIGINT AS items_hit, count(*) AS items, max(overlap) AS max_overlap, round(avg(overlap), 6) AS mean_overlap FROM o GROUP BY n")
def contamination_summary(spark, sf_dir):
    return C.summary(contamination_overlap(spark, sf_dir))


# RE2 has no lookahead, so that pattern stands as two predicates, and its \\b knows ASCII only.
_AHEAD = "creative commons attribution(?!.*(share|noncommercial|noderiv)).*4"


def _spdx_sql() -> str:
    out = []
    for name, pattern in S.SPDX:
        pattern = pattern.replace(r"\bmit license\b|\bmit\b", r"(^|[^\p{L}\p{M}\p{N}_])mit($|[^\p{L}\p{M}\p{N}_])")
        if "(?!" in pattern:
            plain = pattern.replace("|" + _AHEAD, "")
            rest = "regexp_extract(text, '(?i)creative commons attribution(.*)', 1)"
            test = f"(regexp_matches(text, '(?i){plain}') OR (regexp_matches({rest}, '(?i)4') AND NOT regexp_matches({rest}, '(?i)(share|noncommercial|noderiv)')))"
        else:
            test = f"regexp_matches(text, '(?i){pattern}')"
        out.append(f"WHEN {test} THEN '{name}'")
    return "CASE " + " ".join(out) + " END"


@query(f"SELECT spdx, count(*) AS n FROM (SELECT {_spdx_sql()} AS spdx FROM documents) GROUP BY spdx")
def license_spdx_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(S.spdx(F.col("text")).alias("spdx")).groupBy("spdx").agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT *, (o_orderkey // 4) % 9 AS f FROM orders)
    SELECT o_orderkey, CASE WHEN f IN (0, 1) THEN strftime(o_orderdate, '%Y-%m') WHEN f < 7 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE year(o_orderdate)::VARCHAR END AS iso, year(o_orderdate)::VARCHAR AS year FROM k""")
def date_iso(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.pmod(F.expr("o_orderkey div 4"), F.lit(9))
    text = F.date_format(d, "MM/dd/yyyy")
    for i, form in enumerate(("MMMM yyyy", "MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "yyyy-MM-dd", "yyyy")):
        text = F.when(k == i, F.date_format(d, form)).otherwise(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", S.iso_date(text).alias("iso"), S.year(text).alias("year"))


_URL = "regexp_replace(regexp_replace(lower(trim(url)), '/+$', ''), '^https?://', '')"


@query(f"SELECT page_id, {_URL} AS url FROM pages")
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.normal_url(F.col("url")).alias("url"))


@query(f"""SELECT host, page_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY n_chars DESC, page_id DESC) AS r
    FROM (SELECT string_split({_URL}, '/')[1] AS host, page_id, coalesce(length(html), 0)::INT AS n_chars FROM pages WHERE url IS NOT NULL)) WHERE r = 1""")
def dedup_keep_best(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").where("url is not null").select(F.split_part(S.normal_url(F.col("url")), F.lit("/"), F.lit(1)).alias("host"), "page_id", F.coalesce(F.length("html"), F.lit(0)).alias("n_chars"))
    return X.best_per_key(pages, "host", F.struct("n_chars", "page_id"), ["page_id", "n_chars"])


@query("""WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')) AS a,
        list_distinct(regexp_extract_all(lower(coalesce(lead(text) OVER w, '')), '[\\p{L}\\p{N}_]+')) AS b, lead(turn) OVER w AS nxt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    n AS (SELECT conv_id, turn, len(a) AS x, len(b) AS y, len(list_intersect(a, b)) AS z FROM t WHERE nxt IS NOT NULL)
    SELECT conv_id, turn, round(CASE WHEN x = 0 AND y = 0 THEN 1 ELSE 2.0::DOUBLE * z / (x + y) END, 6) AS f1,
        round(CASE WHEN x + y - z = 0 THEN 1 ELSE z::DOUBLE / (x + y - z) END, 6) AS jaccard, round(CASE WHEN x = 0 OR y = 0 THEN 0 ELSE z / sqrt(x::DOUBLE * y) END, 6) AS cosine FROM n""")
def text_pair_similarity(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lead("text").over(w).alias("other"), F.lead("turn").over(w).alias("nxt")).where("nxt is not null")
    sets = pairs.select("conv_id", "turn", S.token_set(F.col("text")).alias("a"), S.token_set(F.col("other")).alias("b"))
    a, b = F.col("a"), F.col("b")
    return sets.select("conv_id", "turn", F.round(S.token_f1(a, b), 6).alias("f1"), F.round(S.jaccard(a, b), 6).alias("jaccard"), F.round(S.set_cosine(a, b), 6).alias("cosine"))


@query("""SELECT doc_id, round(CASE WHEN coalesce(length(text), 0) = 0 THEN 1 ELSE length(regexp_replace(text, '[\\p{L}\\p{N}\\s.,;:!?''"()\\-\\[\\]{}/\\\\@#$%&*+=<>_|~`]', '', 'g'))::DOUBLE / length(text) END, 6) AS odd_share FROM documents""")
def gibberish_ratio(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(S.odd_share(F.col("text")), 6).alias("odd_share"))


@query("""SELECT source, count(*) AS n, count(quality) AS n_labelled, count_if(quality IS NULL)::BIGINT AS missing, count_if(quality = 0 AND toxic = 1)::BIGINT AS bad,
    round(100 * count(quality) / count(*), 6) AS coverage FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def coverage_fill_rate(spark, sf_dir):
    both = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    q = F.col("quality")
    return both.groupBy("source").agg(F.count("*").alias("n"), F.count(q).alias("n_labelled"), F.count_if(q.isNull()).alias("missing"), F.count_if((q == 0) & (F.col("toxic") == 1)).alias("bad"), F.round(100 * F.count(q) / F.count("*"), 6).alias("coverage"))


@query("""WITH p AS (SELECT p_brand, count(*) AS n, count_if(p_size > 25) AS hits FROM part GROUP BY 1), q AS (SELECT *, hits / n AS p, 1 + 1.96 * 1.96 / n::DOUBLE AS d FROM p),
    r AS (SELECT *, (p + 1.96 * 1.96 / (2 * n)::DOUBLE) / d AS mid, 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)::DOUBLE) / d AS half FROM q)
    SELECT p_brand, n, hits::BIGINT AS hits, round(greatest(0, 100 * (mid - half)), 6) AS low, round(least(100, 100 * (mid + half)), 6) AS high, round(2 * asin(sqrt(p)) - 2 * asin(sqrt(0.5)), 6) AS h FROM r""")
def wilson_fill_rate(spark, sf_dir):
    n = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("hits"))
    low, high = S.wilson(F.col("hits"), F.col("n"))
    return n.select("p_brand", "n", "hits", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), F.round(S.cohens_h(F.col("hits") / F.col("n"), F.lit(0.5)), 6).alias("h"))


@query("""WITH r AS (SELECT p_size, p_retailprice, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS rx,
        rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS ry FROM part)
    SELECT count(*) AS n, round(corr(p_size, p_retailprice), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r""")
def spearman_pearson(spark, sf_dir):
    return T.correlations(table(spark, sf_dir, "part").select("p_size", "p_retailprice"), "p_size", "p_retailprice")


@query("""SELECT count(*) AS n, round(1 - avg((x - y) ** 2) / (avg(x * x) + avg(y * y) - 2 * avg(x) * avg(y)), 6) AS kappa
    FROM (SELECT quality::DOUBLE AS x, toxic::DOUBLE AS y FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)""")
def kappa_quadratic(spark, sf_dir):
    return T.quadratic_kappa(table(spark, sf_dir, "labels").where("quality is not null and toxic is not null"), "quality", "toxic")


VOTES = "WITH c AS (SELECT l_orderkey, l_returnflag AS v, count(*) AS c, sum(count(*)) OVER (PARTITION BY l_orderkey) AS m FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1, 2)"


@query(VOTES + """, b AS (SELECT v, sum(c) AS nv, sum(c * (m - c)::DOUBLE / (m - 1)) AS off FROM c WHERE m > 1 GROUP BY v)
    SELECT sum(nv)::BIGINT AS n, round(1 - (sum(nv) - 1) * sum(off) / (sum(nv) ** 2 - sum(nv * nv)), 6) AS alpha FROM b""")
def krippendorff_nominal(spark, sf_dir):
    return T.krippendorff_nominal(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


@query(VOTES + """, t AS (SELECT *, max(c) OVER (PARTITION BY l_orderkey) AS top FROM c)
    SELECT l_orderkey, CASE WHEN count(*) = 1 AND any_value(m) > 1 THEN min(v) END AS winner, any_value(m)::BIGINT AS n_votes, max(c) AS n_winner, count(*) > 1 AS tie FROM t WHERE c = top GROUP BY l_orderkey""")
def consensus_vote(spark, sf_dir):
    return T.majority(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IS NOT NULL)")
def anti_overlap_selection(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(urgent, "c_custkey", "left_anti")


@query("""SELECT lang, doc_id, pick FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('42' || doc_id::VARCHAR), doc_id)::INT AS pick FROM documents) WHERE pick <= 20""")
def stratified_sample(spark, sf_dir):
    return X.stratified(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id", 20)


@query("""WITH h AS (SELECT doc_id, ('0x' || md5('split' || doc_id::VARCHAR)[1:4])::INT / 65536 AS x FROM documents)
    SELECT doc_id, CASE WHEN x < 0.8 THEN 'train' WHEN x < 0.9 THEN 'validation' ELSE 'test' END AS part FROM h""")
def split_80_10_10(spark, sf_dir):
    return X.split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


FLAGS = ("A", "N", "R")


@query("SELECT l_linestatus, n, " + ", ".join(f"n_{v}, round(100 * n_{v} / n, 6) AS pct_{v}" for v in FLAGS) + " FROM (SELECT l_linestatus, count(*) AS n, " + ", ".join(f"count_if(l_returnflag = '{v}')::BIGINT AS n_{v}" for v in FLAGS) + " FROM lineitem GROUP BY 1)")
def crosstab_pct(spark, sf_dir):
    return T.crosstab(table(spark, sf_dir, "lineitem"), "l_linestatus", "l_returnflag", list(FLAGS))


EDGES = (0, 50_000, 100_000, 200_000, 300_000, 1_000_000)


@query("WITH b AS (SELECT unnest(range(5))::INT AS bin), c AS (SELECT CASE " + " ".join(f"WHEN o_totalprice >= {a} AND o_totalprice {'<=' if i == 4 else '<'} {b} THEN {i}" for i, (a, b) in enumerate(zip(EDGES, EDGES[1:], strict=False))) + " END AS bin FROM orders) SELECT bin, count(c.bin) AS n FROM b LEFT JOIN c USING (bin) GROUP BY bin")
def histogram_bins(spark, sf_dir):
    return X.histogram(table(spark, sf_dir, "orders"), F.col("o_totalprice"), list(EDGES))


@query("""WITH c AS (SELECT year(o_orderdate) AS y, count(*) AS c FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1),
    s AS (SELECT unnest(range(min(y), max(y) + 1)) AS y FROM c) SELECT s.y::INT AS year, coalesce(c.c, 0)::BIGINT AS n FROM s LEFT JOIN c USING (y)""")
def dense_year_range(spark, sf_dir):
    return X.dense_years(table(spark, sf_dir, "orders"), F.col("o_orderdate"))


@query("""WITH r AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations)
    SELECT conv_id, count(*) AS turns, count_if(text IS NULL OR trim(text) = '')::BIGINT AS empty_turns, count_if(role = before)::BIGINT AS repeated_roles, max(CASE WHEN i = 1 THEN role END) AS first_role FROM r GROUP BY conv_id""")
def chat_validation(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("before", F.lag("role").over(w)).withColumn("i", F.row_number().over(w))
    empty = F.col("text").isNull() | (F.trim("text") == "")
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(empty).alias("empty_turns"), F.count_if(F.col("role") == F.col("before")).alias("repeated_roles"), F.max(F.when(F.col("i") == 1, F.col("role"))).alias("first_role"))


@query("""SELECT role, count(*) AS calls, sum(length(text) // 4)::BIGINT AS tokens, round(sum(length(text) // 4) * CASE WHEN role = 'assistant' THEN 15.0 ELSE 3.0 END / 1000000, 6)::DOUBLE AS usd FROM conversations GROUP BY role""")
def cost_per_role(spark, sf_dir):
    n = table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("calls"), F.sum(F.expr("length(text) div 4")).alias("tokens"))
    return n.withColumn("usd", F.round(F.col("tokens") * F.when(F.col("role") == "assistant", 15.0).otherwise(3.0) / 1000000, 6))


QUERY = ["data", "people", "time"]
_IDF = "(ln((n + 1) / (df + 1)) + 1)"


@query(f"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, unnest(range(len(ps))) AS para, ps FROM s),
    w AS (SELECT doc_id, para, regexp_extract_all(lower(trim(ps[para + 1])), '{D.TERM}') AS w FROM p WHERE length(trim(ps[para + 1])) >= 60),
    r AS (SELECT *, len(w) AS len FROM w WHERE len(w) > 0), k AS (SELECT doc_id, count(*) AS n FROM r GROUP BY 1),
    t AS (SELECT doc_id, para, len, term, count(*) AS c FROM (SELECT doc_id, para, len, unnest(w) AS term FROM r) GROUP BY ALL),
    d AS (SELECT doc_id, term, count(*) AS df FROM t GROUP BY ALL),
    x AS (SELECT doc_id, para, term, c / len * {_IDF} AS x, {_IDF} AS i FROM t JOIN d USING (doc_id, term) JOIN k USING (doc_id)),
    z AS (SELECT doc_id, sum(((ln((n + 1) / (coalesce(df, 0) + 1)) + 1) / 3) ** 2) AS qq FROM (SELECT * FROM k, (VALUES ('data'), ('people'), ('time')) AS v(term)) LEFT JOIN d USING (doc_id, term) GROUP BY 1),
    o AS (SELECT doc_id, para, sum(CASE WHEN term IN ('data', 'people', 'time') THEN x * i / 3 ELSE 0 END) AS dot, sum(x * x) AS pp FROM x GROUP BY ALL),
    f AS (SELECT doc_id, para::INT AS para, round(dot / sqrt(pp * qq), 6) AS score FROM o JOIN z USING (doc_id) WHERE dot > 0)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, para)::INT AS place FROM f) WHERE place <= 5""")
def tfidf_search(spark, sf_dir):
    paras = D.paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text", "\n")
    return D.search(paras, "doc_id", QUERY)


KEYWORDS = {"license": ["license", "copyright"], "collection": ["collected", "data"], "privacy": ["email", "personal", "phone"]}


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, (" + " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)}" for w in ws) + ")::BIGINT AS hits FROM documents" for f, ws in KEYWORDS.items()) + ") WHERE hits > 0")
def keyword_index(spark, sf_dir):
    return D.keyword_index(table(spark, sf_dir, "documents"), "doc_id", "text", KEYWORDS)


@query("""WITH t AS (SELECT source, length(text) // 4 AS n FROM documents WHERE text IS NOT NULL)
    SELECT source, CASE WHEN n < 8000 THEN 'short' WHEN n < 20000 THEN 'medium' ELSE 'long' END AS size, count(*) AS docs, sum(n)::BIGINT AS tokens FROM t GROUP BY ALL""")
def length_classes(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text is not null").select("source", D.token_estimate(F.col("text")).alias("n"))
    return rows.groupBy("source", D.length_class(F.col("n")).alias("size")).agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))


@query("SELECT doc_id, md5(CASE WHEN length(text) <= 1000 THEN text ELSE left(text, 600) || chr(10) || '[...]' || chr(10) || right(text, 200) END) AS cut_md5 FROM documents")
def smart_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(D.head_and_tail(F.col("text"), 1000)).alias("cut_md5"))


@query(VOTES + """, u AS (SELECT * FROM c WHERE m = 3), v AS (SELECT v, sum(c)::DOUBLE AS nv, sum(c * c)::DOUBLE AS sq FROM u GROUP BY v),
    t AS (SELECT sum(nv) AS a, sum(sq) AS s, sum(nv * nv) AS p FROM v)
    SELECT (a / 3)::BIGINT AS units, round(((s - a) / (2 * a) - p / (a * a)) / (1 - p / (a * a)), 6) AS kappa FROM t""")
def fleiss_kappa(spark, sf_dir):
    return T.fleiss(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", 3)


@query("""WITH d AS (SELECT p_size - 25 AS d, abs(p_size - 25) AS s FROM part WHERE p_size <> 25),
    r AS (SELECT d, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM d),
    t AS (SELECT sum(c ** 3 - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM d GROUP BY s)),
    w AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus FROM r)
    SELECT n, w_plus, w_minus, round((w_plus - n * (n + 1) / 4) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - t / 48), 6) AS z FROM w, t""")
def wilcoxon_signed_rank(spark, sf_dir):
    return T.wilcoxon(table(spark, sf_dir, "part").select("p_size", F.lit(25).alias("mid")), "p_size", "mid")


@query("SELECT min(l_quantity) AS low, round(avg(l_quantity), 6) AS mean, round(quantile_cont(l_quantity, 0.5), 6) AS p50, round(quantile_cont(l_quantity, 0.95), 6) AS p95, max(l_quantity) AS high FROM lineitem")
def distribution_stats(spark, sf_dir):
    return T.distribution(table(spark, sf_dir, "lineitem"), "l_quantity")


@query("SELECT quality, toxic, count(*) AS n, abs(quality - toxic) AS off_by FROM labels GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return T.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


@query("""WITH r AS (SELECT lang, doc_id, greatest(1, round_even(count(*) OVER (PARTITION BY lang) * 0.1::DOUBLE, 0)) AS h, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY md5('domain' || doc_id::VARCHAR), doc_id) AS i FROM documents)
    SELECT lang, doc_id, CASE WHEN n < 3 OR i > 2 * h THEN 'train' WHEN i <= h THEN 'test' ELSE 'validation' END AS part FROM r""")
def domain_split(spark, sf_dir):
    return X.domain_split(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id")


def _records(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    poor = F.col("c_acctbal") < 0
    ours = F.create_map(F.lit("name"), "c_name", F.lit("segment"), F.when(~poor, F.col("c_mktsegment")))
    host = F.create_map(F.lit("segment"), F.when(F.col("c_custkey") % 2 == 0, F.lit("HOST")), F.lit("nation"), F.col("c_nationkey").cast("string"))
    return c.select("c_custkey", ours.alias("ours"), host.alias("host"))


_SEG = "CASE WHEN c_custkey % 2 = 0 THEN 'HOST' WHEN c_acctbal >= 0 THEN c_mktsegment END"


@query(f"""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'segment,' ELSE '' END || 'nation' AS missing, CASE WHEN c_custkey % 2 = 1 AND c_acctbal >= 0 THEN 'name,segment' ELSE 'name' END AS added,
    CASE WHEN c_custkey % 2 = 0 AND c_acctbal >= 0 THEN 'segment' ELSE '' END AS kept,
    '{{"name":"' || c_name || '"' || coalesce(',"segment":"' || {_SEG} || '"', '') || ',"nation":"' || c_nationkey || '"}}' AS doc FROM customer""")
def record_merge(spark, sf_dir):
    ours, host = F.col("ours"), F.col("host")
    ordered = R.merged(ours, host)
    doc = F.create_map(*[x for f in ("name", "segment", "nation") for x in (F.lit(f), F.element_at(ordered, f))])
    missing = F.array_join(R.missing(ours, ["name", "segment", "nation"]), ",")
    return _records(spark, sf_dir).select("c_custkey", missing.alias("missing"), F.array_join(R.added(ours, host), ",").alias("added"), F.array_join(R.kept(ours, host), ",").alias("kept"), R.document(doc).alias("doc"))
