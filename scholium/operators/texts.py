"""Search and measures over texts: paragraphs, TF-IDF, keyword counts, length classes; built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERM = r"[a-z][a-z0-9_-]+"


def paragraphs(docs: DataFrame, doc_id: str, text: str, boundary: str = r"\n\s*\n", least: int = 60) -> DataFrame:
    """(doc, para, body): trimmed parts of at least ``least`` characters, with their place in the text."""
    parts = docs.select(doc_id, F.posexplode(F.split(text, boundary)).alias("para", "body"))
    return parts.withColumn("body", F.trim("body")).where(F.length("body") >= least)


def search(paras: DataFrame, doc_id: str, query: list[str], k: int = 5) -> DataFrame:
    """The k paragraphs of each document nearest to the query by TF-IDF cosine; zero scores are left out.

    tf is count by length and idf is ln((N + 1) / (df + 1)) + 1 over the paragraphs of the document, also for query words
    that it lacks. Terms move once, by document and term; norms and products are one aggregate.
    """
    words = F.regexp_extract_all(F.lower("body"), F.lit(f"({TERM})"), 1)
    rows = paras.select(doc_id, "para", words.alias("w")).where(F.size("w") > 0)
    counts = rows.groupBy(doc_id).agg(F.count("*").alias("n"))
    terms = rows.select(doc_id, "para", F.size("w").alias("len"), F.explode("w").alias("term")).groupBy(doc_id, "para", "len", "term").agg(F.count("*").alias("c"))
    df = terms.groupBy(doc_id, "term").agg(F.count("*").alias("df"))

    def idf(n, d):
        return F.log((n + 1) / (d + 1)) + 1

    share = {q: query.count(q) / len(query) for q in query}
    mine = F.lit(0.0)
    for q, s in share.items():
        mine = F.when(F.col("term") == q, s).otherwise(mine)
    weighed = terms.join(df, [doc_id, "term"]).join(counts, doc_id)
    i = idf(F.col("n"), F.col("df"))
    x = F.col("c") / F.col("len") * i
    dots = weighed.groupBy(doc_id, "para").agg(F.sum(x * mine * i).alias("dot"), F.sum(x * x).alias("pp")).where("dot > 0")
    seen = [F.max(F.when(F.col("term") == q, F.col("df"))).alias(f"d{j}") for j, q in enumerate(share)]
    norms = df.where(F.col("term").isin(*share)).groupBy(doc_id).agg(*seen).join(counts, doc_id)
    square = sum((F.pow(s * idf(F.col("n"), F.coalesce(f"d{j}", F.lit(0))), 2.0) for j, s in enumerate(share.values())), F.lit(0.0))
    scored = dots.join(norms.select(doc_id, square.alias("qq")), doc_id).select(doc_id, "para", F.round(F.col("dot") / F.sqrt(F.col("pp") * F.col("qq")), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy(doc_id).orderBy(F.desc("score"), "para"))
    return scored.withColumn("place", place).where(F.col("place") <= k)


def keyword_index(docs: DataFrame, doc_id: str, text: str, keywords: dict[str, list[str]]) -> DataFrame:
    """(doc, field, hits): how often the field's keywords stand in the text (no overlaps); one pass, no join, no shuffle."""
    low = F.lower(text)
    each = [F.struct(F.lit(f).alias("field"), sum(((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w) for w in ws), F.lit(0)).cast("long").alias("hits")) for f, ws in keywords.items()]
    return docs.select(doc_id, F.explode(F.array(*each)).alias("x")).select(doc_id, "x.*").where("hits > 0")


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def length_class(tokens: Column) -> Column:
    return F.when(tokens < 8000, "short").when(tokens < 20000, "medium").otherwise("long")


def head_and_tail(text: Column, limit: int, marker: str = "\n[...]\n") -> Column:
    """A text over ``limit`` as its first 60 and last 20 per cent of the limit; shorter ones as they are."""
    head, tail = int(limit * 0.6), int(limit * 0.2)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit(marker), F.right(text, F.lit(tail))))
