"""Queries on single values: null dialects, canonical forms, field scores. A part's key deals the examples over its rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholium.catalogue import query, table
from scholium.functions import fields, names, nulls
from scholium.functions import scalars as S


def dealt(values: list[str | None], key: str, by: int = 1) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.expr(f"{key} div {by}"), F.lit(len(values))) + 1).cast("int"))


def sql(values: list[str | None], key: str, by: int = 1) -> str:
    quoted = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[1 + ({key} // {by}) % {len(values)}]"


ANSWERS = [None, "", "  ", "MIT", "null", "N/A", "NA", "none.", "Unknown", "unknown-source corpus", "Natural Questions", "NA-12 cohort", "[NULL - not found in paper]", "[na] nothing", "Not specified", "not specified by us", "the licence is not mentioned in paper", "not provided", "not applicable", "[n/a", "None of these", "nullable types", "not available", "[null]"]
TRIM = "regexp_replace(coalesce({0}, ''), '^\\s+|\\s+$', '', 'g')"
WORDS = "'null', 'none', 'n/a', 'na', 'unknown', 'not disclosed', 'not found', 'not mentioned', 'not specified', 'not applicable', 'not available'"
PHRASES = "(contains({0}, 'not found in paper') OR contains({0}, 'not mentioned in paper') OR contains({0}, 'not specified in paper'))"
GOLD_NULL = "({0} = '' OR {0} IN (" + WORDS + ") OR regexp_matches({0}, '^(\\[null|(null|n/?a|none|unknown)[\\s.,;:-]*$|not (disclosed|found|mentioned|specified|applicable|available)\\b)') OR starts_with({0}, '[null') OR starts_with({0}, '[na') OR starts_with({0}, '[n/a') OR " + PHRASES + ")"
FIELD_NULL = "({0} = '' OR {0} IN (" + WORDS + ") OR starts_with({0}, '[null') OR starts_with({0}, '[na]') OR starts_with({0}, '[n/a') OR " + PHRASES + ")"


def low(x: str) -> str:
    return f"lower({TRIM.format(x)})"


@query(f"""WITH v AS (SELECT p_partkey, {sql(ANSWERS, 'p_partkey')} AS gold, {sql(ANSWERS, 'p_partkey', len(ANSWERS))} AS answer FROM part),
    t AS (SELECT *, {low('gold')} AS g, {low('answer')} AS a FROM v)
    SELECT p_partkey, {GOLD_NULL.format('g')} AS gold, {FIELD_NULL.format('g')} AS field, g IN ('', 'not specified', 'unknown') OR starts_with(g, '[null') AS coverage,
        g IN ('', 'not mentioned', 'not available', 'n/a', 'unknown', 'not specified', 'not provided', 'null') AS unfilled, g IN ('', 'null', 'none', 'n/a', 'na', 'not mentioned', 'not applicable', 'unknown') AS nullish,
        g IN ('', 'null', 'none', 'n/a', 'not applicable', '[null]', '[null - not found in paper]') AS detail, g IN ('', 'none', 'null', '[null]') AS truth, g = '' OR starts_with(g, '[null') AS bracket,
        CASE WHEN {GOLD_NULL.format('g')} THEN (CASE WHEN a = '' THEN 'correct_null' ELSE 'hallucination' END) WHEN a = '' THEN 'miss' ELSE 'compare' END AS class FROM t""")
def null_classification(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", dealt(ANSWERS, "p_partkey").alias("g"), dealt(ANSWERS, "p_partkey", len(ANSWERS)).alias("a"))
    return rows.select("p_partkey", *[rule(F.col("g")).alias(name) for name, rule in nulls.DIALECTS.items()], nulls.pair_class(F.col("g"), F.col("a")).alias("class"))


LICENCES = ["CC BY 4.0", "Creative Commons Attribution 4.0 International", "creative commons attribution-sharealike 4.0", "CC-BY-NC-SA 4.0", "https://creativecommons.org/licenses/by-sa/3.0/", "https://choosealicense.com/licenses/mit/", "https://choosealicense.com/licenses/isc", "The MIT License", "Apache License, Version 2.0", "apache-2.0 licence", "GNU GPL v3", "GPL 3.0", "BSD 3-Clause", "public domain", "CC0 1.0", "Creative Commons Attribution Non Commercial 4.0", "ODC-By", "proprietary", "Unknown", "see https://x.org/a", "cc by", "mit-style"]
KNOWN = ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(names.spellings()))


def _rewritten(x: str) -> str:
    for pattern, to in names.LICENCE_REWRITES:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


@query(f"""WITH k(i, k, c) AS (VALUES {KNOWN}), v AS (SELECT DISTINCT {sql(LICENCES, 'p_partkey')} AS raw FROM part),
    t AS (SELECT raw, {low('raw')} AS t, {_rewritten(low('raw'))} AS r, regexp_extract({low('raw')}, 'choosealicense\\.com/licenses?/([\\w.-]+)', 1) AS slug FROM v),
    n AS (SELECT raw, min_by(c, i) AS near FROM t JOIN k ON starts_with(r, k.k) OR starts_with(k.k, r) GROUP BY raw),
    c AS (SELECT t.raw, CASE WHEN regexp_matches(t, 'creativecommons\\.org/licenses?/[\\w-]+/[\\d.]+') THEN regexp_replace(regexp_extract(t, 'creativecommons\\.org/licenses?/([\\w-]+/[\\d.]+)', 1), '^(.*)/', 'cc-\\1-')
        WHEN slug <> '' THEN coalesce(s.c, slug) ELSE coalesce(e.c, n.near, r) END AS licence
        FROM t LEFT JOIN k s ON s.k = slug LEFT JOIN k e ON e.k = r LEFT JOIN n ON n.raw = t.raw)
    SELECT raw, licence, count(*) AS n FROM (SELECT {sql(LICENCES, 'p_partkey')} AS raw FROM part) JOIN c USING (raw) GROUP BY ALL""")
def license_normalized(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(dealt(LICENCES, "p_partkey").alias("raw"))
    return rows.select("raw", names.licence(F.col("raw")).alias("licence")).groupBy("raw", "licence").agg(F.count("*").alias("n"))


@query(f"""WITH v AS (SELECT p_partkey, {sql(LICENCES, 'p_partkey')} AS raw FROM part), k(k, c) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in names.CATALOGUE.items())})
    SELECT p_partkey, coalesce(c, raw) AS licence FROM v LEFT JOIN k ON k = lower(trim(raw))""")
def license_catalogue(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", names.catalogue_licence(dealt(LICENCES, "p_partkey")).alias("licence"))


TONGUES = ["English", "en", "English, German", "de/en", "de and en", "deu; eng.", "French", "zh", "Klingon", "multilingual", "es it  pt", "en, en", "polish ,  pl", ""]
CODES = ", ".join(f"('{c}', '{n}')" for n, cs in names.LANGUAGES.items() for c in cs)


@query(f"""WITH m(c, n) AS (VALUES {CODES}), v AS (SELECT p_partkey, {sql(TONGUES, 'p_partkey')} AS a, {sql(TONGUES, 'p_partkey', len(TONGUES))} AS b FROM part),
    w AS (SELECT x, list_sort(list(DISTINCT coalesce(n, p))) AS s FROM (SELECT x, regexp_replace(trim(unnest(string_split_regex(lower(trim(x)), '[,;/]\\s*|\\s+and\\s+|\\s+'))), '\\.+$', '') AS p
        FROM (SELECT DISTINCT unnest([a, b]) AS x FROM v)) LEFT JOIN m ON c = p WHERE p <> '' GROUP BY x)
    SELECT p_partkey, coalesce(array_to_string(l.s, ','), '') AS languages, coalesce(l.s, []) = coalesce(r.s, []) AS same FROM v LEFT JOIN w l ON l.x = a LEFT JOIN w r ON r.x = b""")
def language_set_match(spark, sf_dir):
    a, b = dealt(TONGUES, "p_partkey"), dealt(TONGUES, "p_partkey", len(TONGUES))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(names.languages(a), ",").alias("languages"), (names.languages(a) == names.languages(b)).alias("same"))


TITLES = ["MMLU", "mmlu", "MMLU (Massive Multitask Language Understanding)", "Multilingual LibriSpeech (MLS)", "mls_eng_10k", "mls", "Stanford Question Answering Dataset", "squad", "GSM8K benchmark", "gsm8k", "open_web_text", "Open-Web Text corpus", "C4", "The Pile"]


def _plain(x: str) -> str:
    return f"translate(trim(regexp_replace(trim(regexp_replace(lower(trim({x})), '\\s*\\(.*?\\)\\s*', ' ', 'g')), '\\s*(dataset|benchmark|corpus)\\s*$', '')), '_-', '  ')"


@query(f"""WITH v AS (SELECT p_partkey, {sql(TITLES, 'p_partkey')} AS a, {sql(TITLES, 'p_partkey', len(TITLES))} AS b FROM part),
    t AS (SELECT *, lower(a) AS x, lower(b) AS y, {_plain('a')} AS px, {_plain('b')} AS py, regexp_extract_all(a, '\\(([A-Z]{{2,}})\\)', 1) AS sa, regexp_extract_all(b, '\\(([A-Z]{{2,}})\\)', 1) AS sb,
        regexp_extract_all(lower(a), '[\\p{{L}}\\p{{N}}_]+') AS wa, regexp_extract_all(lower(b), '[\\p{{L}}\\p{{N}}_]+') AS wb FROM v)
    SELECT p_partkey, px AS plain, contains(x, y) OR contains(y, x) OR contains(px, py) OR contains(py, px) OR len(list_filter(sa, lambda s: contains(y, lower(s)))) > 0 OR len(list_filter(sb, lambda s: contains(x, lower(s)))) > 0
        OR (len(wa) > 0 AND list_has_all(wb, wa)) OR (len(wb) > 0 AND list_has_all(wa, wb)) AS same FROM t""")
def name_match_pairs(spark, sf_dir):
    a, b = dealt(TITLES, "p_partkey"), dealt(TITLES, "p_partkey", len(TITLES))
    return table(spark, sf_dir, "part").select("p_partkey", names.plain_name(a).alias("plain"), names.names_match(a, b).alias("same"))


IDS = ["org/data.set-v1", "a b/c", "https://hub.example/datasets/org/name", "2301.01234v2", "see arXiv:1706.03762v5 there", "rating 2", "3 - wrong", " 1", "0", "x" * 70, "Jane Doe, John Roe and Open Lab", "Ann; Bo Li", "OpenAI (Karl Cobbe, Ann Lee)", "Karl Cobbe (OpenAI)", "http://x.org", "CC BY", "in 1999", ""]


@query(f"""WITH v AS (SELECT p_partkey, {sql(IDS, 'p_partkey')} AS x FROM part), s AS (SELECT *, regexp_replace(replace(x, '/', '__'), '[^a-zA-Z0-9_-]', '_', 'g') AS safe FROM v)
    SELECT p_partkey, CASE WHEN length(safe) > 64 THEN safe[1:51] || '_' || md5(x)[1:12] ELSE safe END AS safe_id, nullif(regexp_extract(x, '(\\d{{4}}\\.\\d{{4,5}})(v\\d+)?', 1), '') AS arxiv,
        regexp_replace(regexp_replace(trim(x), '^https?://[^/]+/(datasets/)?', ''), '^([^/]*)/', '\\1_') AS hub, nullif(regexp_extract(x, '^\\s*([123])', 1), '')::INT AS rating,
        array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split_regex(lower(x), '[,;]|\\band\\b'), lambda p: trim(regexp_replace(p, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'))), lambda p: length(p) > 2 AND NOT regexp_matches(p, '{names.ORGANISATION}')))), '|') AS people,
        regexp_matches(x, '^https?://\\S+\\.\\S+') AS is_url, regexp_matches(x, '\\b(19|20)\\d{{2}}\\b') AS is_date, trim(regexp_replace(regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM s""")
def identifiers(spark, sf_dir):
    x = dealt(IDS, "p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", names.safe_id(x).alias("safe_id"), names.arxiv_id(x).alias("arxiv"), names.hub_id(x).alias("hub"), names.rating(x).alias("rating"), F.array_join(names.people(x), "|").alias("people"), names.plausible("url", x).alias("is_url"), names.plausible("date", x).alias("is_date"), names.plain_text(x).alias("plain"))


PAIRS = [("sc:publisher", "Allen Institute for AI", "allen institute"), ("sc:publisher", "Meta", "Google Research"), ("sc:datePublished", "Nov 18, 2021", "2021-03"), ("sc:datePublished", "soon", "Soon "), ("cr:isLiveDataset", "Yes", "true"), ("cr:isLiveDataset", "0", "yes"), ("sc:url", "https://a.org/x/", "http://A.org/x"), ("sc:license", "MIT License", "mit"), ("sc:inLanguage", "en, de", "German and English"), ("sc:name", "MMLU (Massive)", "mmlu"), ("sc:creator", "Jane Doe and John Roe", "Jane Doe"), ("sc:description", "a set of texts", "texts of a kind"), ("sc:creator", "", "Jane"), ("sc:url", "x.org", "[NULL - not found in paper]"), ("sc:url", None, "unknown"), ("rai:dataBiases", "some bias", "a bias"), ("rai:dataBiases", " ", "a bias"), ("odd:field", "x", "x")]
EXPECTED = [(1.0, "exact_match"), (0.0, "exact_match"), (1.0, "exact_match"), (1.0, "exact_match"), (1.0, "exact_match"), (0.0, "exact_match"), (1.0, "exact_match"), (1.0, "exact_match"), (1.0, "exact_match"), (1.0, "exact_match"), (0.571429, "token_f1"), (0.75, "token_f1"), (0.0, "missing"), (0.0, "hallucination"), (None, "correct_null"), (0.5, "judge"), (0.0, "missing"), (0.0, "unknown")]
CASES = ", ".join(f"({i}, {'NULL' if s is None else s}, '{m}')" for i, (s, m) in enumerate(EXPECTED))


@query(f"""WITH e(i, score, metric) AS (VALUES {CASES}) SELECT p_partkey, score::DOUBLE AS score, metric, CASE WHEN i < 10 OR i IN (13, 14) THEN 'constrained' WHEN i < 13 THEN 'short_text' WHEN i < 17 THEN 'rai' ELSE 'unknown' END AS kind FROM part JOIN e ON i = p_partkey % {len(PAIRS)}""")
def field_score(spark, sf_dir):
    """Known scores of all kinds of fields; a verdict of 2 stands for the long texts."""
    field, answer, gold = (dealt([x[i] for x in PAIRS], "p_partkey") for i in range(3))
    s = fields.score(field, answer, gold, S.verdict_score(F.lit(2)))
    return table(spark, sf_dir, "part").select("p_partkey", s["score"].alias("raw"), s["metric"].alias("metric"), fields.kind(field).alias("kind")).select("p_partkey", F.round("raw", 6).alias("score"), "metric", "kind")


@query("""WITH t AS (SELECT conv_id, turn, trim(coalesce(text, '')) AS x, trim(coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '')) AS y FROM conversations),
    w AS (SELECT *, list_distinct(regexp_extract_all(lower(x), '[\\p{L}\\p{N}_]+')) AS a, list_distinct(regexp_extract_all(lower(y), '[\\p{L}\\p{N}_]+')) AS b,
        trim(regexp_replace(lower(x), '\\s+', ' ', 'g')) AS cx, trim(regexp_replace(lower(y), '\\s+', ' ', 'g')) AS cy FROM t)
    SELECT conv_id, turn, (lower(x) = lower(y))::DOUBLE AS exact, cx <> '' AND cy <> '' AND (contains(cx, cy) OR contains(cy, cx)) AS either,
        round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1 WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(a) END, 6) AS precision,
        round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1 WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(b) END, 6) AS recall FROM w""")
def turn_overlap(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    x, y = F.trim(F.coalesce("text", F.lit(""))), F.trim(F.coalesce("next", F.lit("")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lead("text").over(w).alias("next"))
    a, b = fields.tokens(x), fields.tokens(y)
    return rows.select("conv_id", "turn", fields.exact(x, y).alias("exact"), fields.contains_either(x, y).alias("either"), F.round(S.token_precision(a, b), 6).alias("precision"), F.round(S.token_precision(b, a), 6).alias("recall"))


@query("""WITH v AS (SELECT conv_id, turn, conv_id % 4 AS f, (conv_id // 4) % 4 AS b FROM conversations)
    SELECT conv_id, turn, CASE WHEN f = 0 OR b = 0 THEN NULL WHEN f = 1 THEN 1 ELSE greatest(f, b) END::INT AS verdict FROM v""")
def judge_both_ways(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    f, b = (F.nullif(F.pmod(F.expr(x), F.lit(4)).cast("int"), F.lit(0)) for x in ("conv_id", "conv_id div 4"))
    return rows.select("conv_id", "turn", fields.judge_both(f, b).alias("verdict"))


@query("""WITH v AS (SELECT *, p_partkey % 3 = 0 AS evidence, p_partkey % 5 = 0 AS enriched, p_partkey % 7 = 0 AS unlikely, p_partkey % 11 = 0 AS none FROM part),
    c AS (SELECT *, CASE WHEN none THEN 0 WHEN unlikely THEN 0.5 WHEN enriched THEN 0.7 WHEN evidence THEN 0.95 ELSE 0.8 END::DOUBLE AS c FROM v)
    SELECT p_partkey, c AS confidence, CASE WHEN none THEN 'NULL' WHEN c >= 0.7 THEN 'VERIFIED' WHEN c >= 0.4 THEN 'UNCERTAIN' ELSE 'LOW_CONFIDENCE' END AS status,
        CASE WHEN none THEN 'absent' WHEN enriched THEN 'enrichment' ELSE 'extraction' END AS source FROM c""")
def value_confidence(spark, sf_dir):
    every = lambda n: F.pmod("p_partkey", F.lit(n)) == 0
    c = fields.confidence(F.when(every(11), "N/A").otherwise(F.col("p_name")), F.when(every(3), "quote"), every(5), every(7))
    return table(spark, sf_dir, "part").select("p_partkey", c.alias("c")).select("p_partkey", "c.*")
