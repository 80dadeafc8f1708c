"""The files that a metadata corpus lies in, as tables: paper texts, answers, gold, verdicts, chats; and how results go back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.functions.fields import short_names
from scholium.operators.documents import payload
from scholium.operators.scoring import last_per_key
from scholium.operators.structure import json_text

PAGE = "\n\n[PAGE_BREAK]\n\n"


def stem(path: Column) -> Column:
    """A file's name without folder and ending."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def folder(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(paper, text, pages) of text and Markdown files, a row a file."""
    rows = _whole(spark, path)
    return rows.select(stem(F.col("path")).alias("paper"), F.col("body").alias("text"), F.size(F.split("body", r"\[PAGE_BREAK\]")).alias("pages"))


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """(system, paper, record, valid) of a folder of JSON files for each system; fields lie under ``extraction``, ``fields`` or at the top.

    What is no JSON object has no record and is not valid: it is kept, so that it can be counted.
    """
    rows = _whole(spark, path).withColumn("record", F.from_json(payload(json_text(F.col("body"))), "map<string,string>"))
    return rows.select(folder(F.col("path")).alias("system"), stem(F.col("path")).alias("paper"), short_names(F.col("record")).alias("record"), F.coalesce(F.size("record") > 0, F.lit(False)).alias("valid"))


def read_markdown_gold(spark: SparkSession, path: str) -> DataFrame:
    """(paper, field, gold) of Markdown files in which each field is a heading of the second or third level or a bold name, and its value what follows."""
    rows = _whole(spark, path).select(stem(F.col("path")).alias("paper"), F.explode(F.split(F.concat(F.lit("\n"), "body"), r"\n(?=#{2,3} |\*\*[\w:]+\*\*)")).alias("part"))
    field = F.regexp_extract("part", r"^(?:#{2,3}\s*|\*\*)([\w:]+)", 1)
    value = F.trim(F.regexp_replace(F.regexp_replace("part", r"^(?:#{2,3}\s*[\w:]+|\*\*[\w:]+\*\*)\s*:?", ""), r"^\s+|\s+$", ""))
    return rows.select("paper", field.alias("field"), F.nullif(value, F.lit("")).alias("gold")).where("field <> ''")


def read_verdicts(spark: SparkSession, paths: list[str], score: str = "score", other: str = "v2min_score") -> DataFrame:
    """Verdicts of several Parquet files as one table; an older file's column of scores under its other name."""
    out = None
    for path in paths:
        rows = spark.read.parquet(path)
        rows = rows.withColumnRenamed(other, score) if other in rows.columns and score not in rows.columns else rows
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    """(messages, instruction, input, output, kind) of JSON lines in either chat format; kind is null for lines of neither."""
    schema = "messages array<struct<role:string,content:string>>, instruction string, input string, output string"
    rows = spark.read.schema(schema).json(path)
    return rows.withColumn("kind", F.when(F.col("messages").isNotNull(), "chatml").when(F.col("instruction").isNotNull(), "alpaca"))


def chat_errors(messages: Column) -> Column:
    """What is wrong with a chat: no messages, an unknown role, an empty turn, no question before the answer."""
    roles = F.transform(messages, lambda m: m["role"])
    return F.array_compact(
        F.array(
            F.when(F.coalesce(F.size(messages), F.lit(0)) == 0, "no messages"),
            F.when(F.exists(roles, lambda r: ~r.isin("system", "user", "assistant")), "unknown role"),
            F.when(F.exists(messages, lambda m: F.trim(F.coalesce(m["content"], F.lit(""))) == ""), "empty turn"),
            F.when(F.array_position(roles, "assistant") < F.array_position(roles, "user"), "answer before question"),
        )
    )


def chatml(turns: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """(key, messages): the turns of each conversation in order, those without text left out."""
    has = turns.where(F.trim(F.coalesce(text, F.lit(""))) != "")
    by = has.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, role, text))).alias("m"))
    return by.select(key, F.transform("m", lambda m: F.struct(m[role].alias("role"), m[text].alias("content"))).alias("messages"))


def write_answers(answers: DataFrame, path: str) -> None:
    """JSON lines of answers, a folder a system."""
    answers.write.mode("overwrite").partitionBy("system").json(path)


def upsert(spark: SparkSession, rows: DataFrame, path: str, keys: list[str], order: str, into: str) -> DataFrame:
    """The table at ``path`` (if there is one) with ``rows``, the last of each key by ``order``, written to ``into`` and read back.

    It is written beside the old one, as a table cannot be read and overwritten at once.
    """
    try:
        both = spark.read.parquet(path).unionByName(rows, allowMissingColumns=True)
    except Exception as e:  # noqa: BLE001  only a path that is not there
        if "PATH_NOT_FOUND" not in str(e):
            raise
        both = rows
    values = [c for c in both.columns if c not in keys]
    packed = both.withColumn("__row", F.struct(*values)).select(*keys, "__row", order)
    last_per_key(packed, keys, "__row", order).select(*keys, "__row.*").write.mode("overwrite").parquet(into)
    return spark.read.parquet(into)


def to_do(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is wanted and not yet done."""
    return wanted.join(done, keys, "left_anti")


def described(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of the files of a folder."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def record_set(rows: DataFrame) -> DataFrame:
    """(field, type): a table's columns under the names that dataset descriptions use."""
    names = {"string": "sc:Text", "bigint": "sc:Integer", "int": "sc:Integer", "double": "sc:Float", "float": "sc:Float", "boolean": "sc:Boolean", "date": "sc:Date", "timestamp": "sc:DateTime"}
    return rows.sparkSession.createDataFrame([(f.name, names.get(f.dataType.simpleString(), "sc:Text")) for f in rows.schema], "field string, type string")
