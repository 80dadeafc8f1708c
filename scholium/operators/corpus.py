"""Putting a corpus together and describing it: domains, samples, selections, counts, costs, leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholium.operators.selection import hashed

# Domains by the words that decide, the first that a text has.
DOMAINS = [
    ("Vision", ["image", "vision", "visual", "object detection", "segmentation", "photo", "video", "scene"]),
    ("Code", ["code", "programming", "software", "bug", "repository"]),
    ("Math", ["math", "arithmetic", "calculation", "geometry", "algebra"]),
    ("Audio", ["speech", "audio", "voice", "spoken", "asr", "tts"]),
    ("Medical", ["medical", "clinical", "health", "biomedical", "radiology"]),
    ("Multimodal", ["multimodal", "multi-modal", "vqa", "chart"]),
    ("Translation", ["translation", "multilingual", "cross-lingual", "parallel corpus"]),
    ("QA", ["question answering", "reading comprehension", "qa", "commonsense"]),
    ("NLP Benchmark", ["benchmark", "evaluation", "multitask", "language understanding"]),
    ("Remote Sensing", ["remote sensing", "satellite", "earth observation", "geospatial"]),
    ("Robotics", ["robot", "embodied", "navigation"]),
    ("NLP", ["text", "nlp", "language", "corpus", "sentiment", "ner"]),
]
# Domains of tasks.
TASKS = {
    "NLP": ["text-classification", "token-classification", "question-answering", "summarization", "translation", "text-generation", "fill-mask", "sentence-similarity", "text2text-generation", "feature-extraction", "text-retrieval", "conversational", "table-question-answering", "zero-shot-classification"],
    "Vision": ["image-classification", "object-detection", "image-segmentation", "image-to-text", "depth-estimation", "video-classification", "image-feature-extraction", "keypoint-detection"],
    "Audio": ["automatic-speech-recognition", "audio-classification", "text-to-speech", "voice-activity-detection", "audio-to-audio"],
    "Multimodal": ["visual-question-answering", "document-question-answering", "image-text-to-text", "video-text-to-text"],
    "Code": ["code-generation"],
    "Other": ["reinforcement-learning", "robotics", "tabular-classification", "tabular-regression", "graph-ml", "time-series-forecasting"],
}


def domain_of_text(text: Column) -> Column:
    """The first domain of which a word stands in the text."""
    t = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit("Uncategorized")
    for name, words in reversed(DOMAINS):
        out = F.when(t.rlike("|".join(w.replace("-", "\\-") for w in words)), name).otherwise(out)
    return out


def domain_of_tasks(tasks: Column) -> Column:
    """The commonest domain of an array of tasks, of equals the first; Other without a known task."""
    of = F.create_map(*[F.lit(x) for d, ts in TASKS.items() for t in ts for x in (t, d)])
    known = F.filter(F.transform(tasks, lambda t: F.element_at(of, t)), lambda d: d.isNotNull())
    counted = F.transform(F.array_distinct(known), lambda d, i: F.struct(F.size(F.filter(known, lambda k: k == d)).alias("n"), (-i).alias("i"), d.alias("d")))
    return F.coalesce(F.array_max(counted)["d"], F.lit("Other"))


def round_robin(rows: DataFrame, field: str, system: str, key: str, k: int, salt: str = "42") -> DataFrame:
    """k rows of each field, taking a row of each system in turn; a row's turn is its place among its system's by hash."""
    turn = F.row_number().over(Window.partitionBy(field, system).orderBy(hashed(key, salt), key))
    first = rows.withColumn("turn", turn).where(F.col("turn") <= k)  # before the second window, so no group is larger than k a system
    place = F.row_number().over(Window.partitionBy(field).orderBy("turn", system))
    return first.withColumn("place", place).where(F.col("place") <= k)


def disjoint_sets(rows: DataFrame, label: str, key: str, sizes: dict[str, int], salt: str = "sets") -> DataFrame:
    """For each class ``n`` rows for calibration and the next ``n`` for validation, by hash."""
    n = F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col(label).cast("string"))
    place = F.row_number().over(Window.partitionBy(label).orderBy(hashed(key, salt), key))
    placed = rows.withColumn("place", place).where(F.col("place") <= 2 * n)
    return placed.withColumn("part", F.when(F.col("place") <= n, "calibration").otherwise("validation"))


def spread(rows: DataFrame, value: str, key: str, k: int) -> DataFrame:
    """k rows from the least to the greatest value at even distances; places come from one count and one rank."""
    n = rows.count()
    wanted = sorted({round(i * (n - 1) / max(1, k - 1)) for i in range(k)}) if n else []
    place = F.row_number().over(Window.orderBy(value, key)) - 1
    return rows.withColumn("place", place).where(F.col("place").isin(wanted) if wanted else F.lit(False))


def rebalanced(chosen: DataFrame, pool: DataFrame, domain: str, key: str, most: int = 20) -> DataFrame:
    """``chosen`` with up to ``most`` rows of the largest domain replaced by rows of ``pool`` from domains that are under the mean share."""
    counts = chosen.groupBy(domain).agg(F.count("*").alias("c"))
    mean = counts.agg(F.avg("c").alias("mean"))
    rare = counts.join(F.broadcast(mean)).where("c < mean").select(domain)
    more = pool.join(F.broadcast(rare), domain, "left_semi").join(chosen.select(key), key, "left_anti").orderBy(hashed(key, "more"), key).limit(most)
    largest = counts.orderBy(F.desc("c"), domain).limit(1).select(domain)
    n = more.agg(F.count("*").alias("n"))
    last = chosen.join(F.broadcast(largest), domain, "left_semi").withColumn("r", F.row_number().over(Window.orderBy(hashed(key, "less"), key))).join(F.broadcast(n)).where(F.col("r") <= F.col("n")).select(key)
    return chosen.join(F.broadcast(last), key, "left_anti").unionByName(more)


def one_to_one(rows: DataFrame, a: str, b: str, order: str) -> DataFrame:
    """First row of each ``a`` in order, and of these the first of each ``b``."""
    first = rows.groupBy(a).agg(F.min_by(F.struct(b, order), F.struct(order, b)).alias("x")).select(a, f"x.{b}", f"x.{order}")
    return first.groupBy(b).agg(F.min_by(F.struct(a, order), F.struct(order, a)).alias("x")).select(f"x.{a}", b, f"x.{order}")


def ends(rows: DataFrame, group: str, value: str, key: str, k: int) -> DataFrame:
    """The k greatest and the k least of each group, with their places."""
    top = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value), key))
    low = F.row_number().over(Window.partitionBy(group).orderBy(value, key))
    high = rows.withColumn("place", top).where(F.col("place") <= k).withColumn("end", F.lit("top"))
    return high.unionByName(rows.withColumn("place", low).where(F.col("place") <= k).withColumn("end", F.lit("bottom")))


def multi_values(rows: DataFrame, text: str, sep: str, k: int) -> DataFrame:
    """Counts of the values of a list in text, the k commonest."""
    values = rows.select(F.explode(F.split(text, sep)).alias("value")).select(F.trim("value").alias("value")).where("value <> ''")
    counts = values.groupBy("value").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(k)


def populated(cells: DataFrame, paper: str, filled: str, groups: list[str]) -> DataFrame:
    """Filled fields of each paper, and over a group's papers their mean, least and greatest and who has them."""
    per = cells.groupBy(paper, *groups).agg(F.count_if(F.col(filled)).alias("n"))
    return per.groupBy(*groups).agg(F.count("*").alias("papers"), F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"), F.min_by(paper, F.struct(-F.col("n"), F.col(paper))).alias("fullest"))


def zero_filled(rows: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Counts of categories in a fixed order, those without rows as zero."""
    dim = rows.sparkSession.createDataFrame(list(enumerate(order)), "place int, category string")
    counts = rows.groupBy(F.col(value).alias("category")).agg(F.count("*").alias("c"))
    return F.broadcast(dim).join(counts, "category", "left").select("place", "category", F.coalesce("c", F.lit(0)).alias("n"))


def labelled(value: Column, synonyms: dict[str, str], missing: str = "Unspecified") -> Column:
    """A label under its usual name."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv]), F.lower(F.trim(value))), F.nullif(F.trim(value), F.lit("")), F.lit(missing))


def audit(value: Column, suspects: list[str]) -> Column:
    """Reasons to look at a value again: A a null rule, B up to 30 characters, C a suspicious word, D signs only, E empty JSON."""
    from scholium.functions import nulls

    v = F.trim(F.coalesce(value, F.lit("")))
    has = F.lit(False)
    for s in suspects:
        has = has | F.lower(v).contains(s)
    return F.array_join(F.array_compact(F.array(F.when(nulls.gold_null(value), "A"), F.when(F.length(v) <= 30, "B"), F.when(has, "C"), F.when(v.rlike(r"^[^\p{L}\p{N}]+$"), "D"), F.when(v.isin("{}", "[]", '""'), "E"))), "")


def family(text: Column) -> Column:
    """A licence's family for plots, by the first word it has."""
    t = F.lower(F.coalesce(text, F.lit("")))
    rules = [("CC BY-NC", t.rlike("nc")), ("CC BY-SA", t.rlike("by.sa")), ("CC BY", t.contains("cc") & t.contains("by")), ("CC0", t.contains("cc0") | t.contains("public domain")), ("MIT", t.contains("mit")), ("Apache", t.contains("apache")), ("GPL", t.contains("gpl")), ("BSD", t.contains("bsd"))]
    out = F.lit("Other")
    for name, hit in reversed(rules):
        out = F.when(hit, name).otherwise(out)
    return out


def architecture(label: Column, prefixes: list[tuple[str, str]]) -> Column:
    """The architecture of a system's label, by the first prefix; else single-pass."""
    out = F.lit("Single-pass")
    for prefix, name in reversed(prefixes):
        out = F.when(label.startswith(prefix), name).otherwise(out)
    return out


def shown(board: DataFrame, search: str = "", equal: dict[str, str] | None = None, by: str = "composite", descending: bool = True) -> DataFrame:
    """Rows of a leaderboard that have a text anywhere and the given values; reference rows first, then in order."""
    rows = board.where(F.lower(F.concat_ws(" ", *board.columns)).contains(search.lower()))
    for column, value in (equal or {}).items():
        rows = rows.where(F.col(column) == value)
    pinned = (F.col("role") != "reference").cast("int")
    return rows.orderBy(pinned, F.desc(by) if descending else F.asc(by), "system")


def newcomer_rank(board: DataFrame, composite: float) -> DataFrame:
    """1 and the number of systems that are strictly better."""
    return board.agg((F.count_if(F.col("composite") > composite) + 1).alias("rank"))


def split_of(rows: DataFrame, a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of the parts of two sets of keys: both, only the first, only the second."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    marks = x.withColumn("a", F.lit(1)).join(y.withColumn("b", F.lit(1)), key, "full")
    return marks.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"), F.count_if(F.col("b").isNull()).alias("n_first"), F.count_if(F.col("a").isNull()).alias("n_second"))


def selection_checks(chosen: DataFrame, gold: DataFrame, key: str, domain: str, text: str) -> DataFrame:
    """(check, passed, detail): no overlap with gold, no repeats, texts long enough and readable, no domain over 60 per cent."""
    overlap = chosen.join(gold, key, "left_semi").agg(F.count("*").alias("d")).select(F.lit("overlap").alias("check"), "d")
    repeats = chosen.groupBy(key).agg((F.count("*") - 1).alias("e")).agg(F.coalesce(F.sum("e"), F.lit(0)).alias("d")).select(F.lit("repeats").alias("check"), "d")
    printable = F.length(F.regexp_replace(F.substring(text, 1, 1000), r"[^\x20-\x7E\s]", "")) / F.greatest(F.lit(1), F.length(F.substring(text, 1, 1000)))
    short = chosen.agg(F.count_if(F.coalesce(F.length(text), F.lit(0)) < 100).alias("d")).select(F.lit("short").alias("check"), "d")
    garbage = chosen.agg(F.count_if(printable < 0.5).alias("d")).select(F.lit("garbage").alias("check"), "d")
    total = chosen.agg(F.count("*").alias("t"))
    share = chosen.groupBy(domain).agg(F.count("*").alias("c")).join(F.broadcast(total)).agg(F.count_if(F.col("c") > 0.6 * F.col("t")).alias("d")).select(F.lit("domain share").alias("check"), "d")
    rows = overlap
    for more in (repeats, short, garbage, share):
        rows = rows.unionByName(more)
    return rows.select("check", (F.col("d") == 0).alias("passed"), F.col("d").cast("long").alias("detail"))


def without_known(rows: DataFrame, gold: DataFrame, key: str, papers: str) -> DataFrame:
    """Rows that are not in gold by either spelling of their id (``org/name`` or ``org_name``) nor by any of an array of papers."""
    spelt = gold.select(key).union(gold.select(F.regexp_replace(key, "^([^/]*)/", "$1_"))).distinct()
    by_id = rows.withColumn("__id", F.regexp_replace(key, "^([^/]*)/", "$1_")).join(spelt.withColumnRenamed(key, "__id"), "__id", "left_anti").drop("__id")
    known = gold.select(F.explode(papers).alias("p")).distinct()
    hit = by_id.select(key, F.explode(papers).alias("p")).join(known, "p", "left_semi").select(key).distinct()
    return by_id.join(hit, key, "left_anti")


def price(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column, batch: Column | None = None, read: Column | None = None, written: Column | None = None, price_read: Column | None = None, price_written: Column | None = None) -> Column:
    """US$ of a call from prices of a million tokens, half of it in a batch, cache reads and writes at their own."""
    zero = F.lit(0.0)
    total = (tokens_in * price_in + tokens_out * price_out + (read * price_read if read is not None else zero) + (written * price_written if written is not None else zero)) / 1e6
    return F.round(total * F.when(batch, 0.5).otherwise(1.0) if batch is not None else total, 4)


def system_costs(calls: DataFrame) -> DataFrame:
    """Per system the mean cost of papers none of whose calls failed, papers left out, and each role's mean.

    ``calls``: system, paper, role, cost, failed.
    """
    papers = calls.groupBy("system", "paper").agg(F.sum("cost").alias("cost"), F.max("failed").alias("failed"), *[F.sum(F.when(F.col("role") == r, F.col("cost"))).alias(r) for r in ("main", "triage")])
    fine = F.when(~F.col("failed"), F.col("cost"))
    return papers.groupBy("system").agg(F.round(F.avg(fine), 6).alias("mean_cost"), F.count_if(F.col("failed")).alias("failed_papers"), *[F.round(F.avg(F.when(~F.col("failed"), F.col(r))), 6).alias(f"mean_{r}") for r in ("main", "triage")])
