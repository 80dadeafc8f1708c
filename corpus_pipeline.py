"""A corpus pipeline: every stage works on all that the one before it kept, through a Parquet table in the shared folder.

Every stage but the last returns the columns of its input, whatever their names; an empty table stays empty; rows that repeat
are decided alike; a row without an id is a document of its own, of which nothing is a copy and which is no copy of another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.llm.jaccard_join import ngram_jaccard_join
from scholium.llm.language import UNKNOWN, learn_fold, with_language
from scholium.llm.packing import harmonic_pack
from scholium.llm.quality_rules import compression_bands
from scholium.llm.queries import vocabulary
from scholium.llm.shared import materialize, release, scratch
from scholium.llm.substring_dedup import remove_repeats

#: No SQL expresses the learnt language models, the compression ratios or the tokenizer.
ORACLE_SQL = None
KEY = "__document"
OWN = "__own_"
READ = ("doc_id", "text", "lang")


def aside(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns that no operator reads under names that no result has."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in READ else OWN + c) for c in docs.columns])


def back(docs: DataFrame) -> list:
    """The columns of ``docs`` in rows of :func:`aside`."""
    return [F.col(f"`{c if c in READ else OWN + c}`").alias(c) for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; those without text or letters go."""
    own = aside(docs)
    found = with_language(own, learn_fold(own), keep=tuple(own.columns))
    return found.where(F.col("lang_pred") != UNKNOWN).select(*back(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    own = aside(docs)
    found = compression_bands(own, keep=tuple(own.columns))
    return found.where("kept").select(*back(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest id; a row without an id is a group of its own.

    A document is an id with a text: rows that repeat an id with another text are told apart by a hash of both.
    """
    own = aside(docs)
    keyed = own.where("doc_id is not null").withColumn(KEY, F.xxhash64("doc_id", "text"))
    groups = ngram_jaccard_join(keyed, doc_id=KEY).select(F.col("doc_id").alias(KEY), "component_id").distinct()
    first = keyed.select("doc_id", KEY).join(groups, KEY).groupBy("component_id").agg(F.min(F.struct("doc_id", KEY)).alias("first"))
    known = keyed.join(first.select("first.*"), ["doc_id", KEY], "left_semi").dropDuplicates(["doc_id", "text"])
    return known.select(*back(docs)).unionByName(docs.where("doc_id is null"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 or more words that a smaller one has; n_chars follows the text where it changed."""
    own = aside(docs)
    found = remove_repeats(own, keep=tuple(own.columns))
    cut = F.col("n_removed") > 0
    changed = {"text": F.col("kept"), "n_chars": F.length("kept")}
    return found.select(*[F.when(cut, changed[c].cast(docs.schema[c].dataType)).otherwise(x).alias(c) if c in changed else x for c, x in zip(docs.columns, back(docs), strict=True)])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    return harmonic_pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language ID", language),
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", repeats),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; the rows are those of the last stage."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch() as keep:
            docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
            keep.append(docs)
        if before:
            release(before)
        before = docs
    return docs
