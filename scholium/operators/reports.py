"""What a run of systems is summed up by: tiers, sources, judges' labels, retrieval, logs of agents, data checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholium.functions import fields as S
from scholium.functions import names as N
from scholium.functions import nulls
from scholium.functions.scalars import token_f1

#: Token F1 above which a text is correct, and above which it is partly so.
CORRECT, PARTLY = 0.85, 0.35


def true_label(field: Column, gold: Column, answer: Column) -> Column:
    """1 correct, 2 partly, 3 wrong; null without gold.

    A constrained field is correct by its own rule (a publisher only if nothing of gold is missing) and partly so if one text
    has the other or over half of gold's words are there; other fields go by token F1.
    """
    g, a = N.trim(gold), N.trim(answer)
    tg, ta = S.tokens(g), S.tokens(a)
    f1 = token_f1(ta, tg)
    shorter = (field == "sc:publisher") & (N.collapsed(a) != N.collapsed(g)) & (F.length(N.collapsed(a)) < F.length(N.collapsed(g)))
    same = S.constrained(field, a, g) == 1
    part = S.contains_either(a, g) | (F.size(F.array_intersect(tg, ta)) > 0.5 * F.size(tg))
    by_rule = F.when(same & shorter, 2).when(same, 1).when(part, 2).otherwise(3)
    by_f1 = F.when(f1 > CORRECT, 1).when(f1 > PARTLY, 2).otherwise(3)
    return F.when(nulls.blank(gold), None).when(nulls.detail_null(answer), 3).when(S.kind(field) == "constrained", by_rule).otherwise(by_f1)


def tier_pivot(cells: DataFrame, tier: Column, tiers: list[str]) -> DataFrame:
    """A row a system, a column a tier: mean over fields of the field's mean."""
    means = cells.where("score is not null").groupBy("system", "field").agg(F.avg("score").alias("m"))
    return means.withColumn("tier", tier).groupBy("system").pivot("tier", tiers).agg(F.round(F.avg("m"), 6))


def best_source(scores: dict[str, Column], band: float = 0.01) -> Column:
    """The source of the greatest score, ``Tie`` if another comes within the band, null without scores."""
    best = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    near = sum((F.coalesce((F.abs(v - best) < band).cast("int"), F.lit(0)) for v in scores.values()), F.lit(0))
    out = F.lit(None).cast("string")
    for name, v in reversed(scores.items()):
        out = F.when(v == best, name).otherwise(out)
    return F.when(near > 1, "Tie").otherwise(out)


def fill_rates(cells: DataFrame, split: str, field: str, filled: str, splits: list[str]) -> DataFrame:
    """Per field the share of filled cells in each split and in all."""
    each = [F.round(100 * F.avg(F.when(F.col(split) == s, F.col(filled).cast("int"))), 6).alias(s) for s in splits]
    return cells.groupBy(field).agg(*each, F.round(100 * F.avg(F.col(filled).cast("int")), 6).alias("overall"))


def null_rates(rows: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """The k columns of greatest share of missing values, from one pass."""
    rates = rows.agg(*[F.avg(nulls.blank(F.col(c).cast("string")).cast("double")).alias(c) for c in columns])
    long = rates.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.round(F.col(c), 6).alias("rate")) for c in columns])).alias("x")).select("x.*")
    return long.orderBy(F.desc("rate"), "column").limit(k)


def out_of_range(rows: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """(column, below, above, missing) for each bounded column."""
    each = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c) < lo).alias("below"), F.count_if(F.col(c) > hi).alias("above"), F.count_if(F.col(c).isNull()).alias("missing")) for c, (lo, hi) in bounds.items()]
    return rows.agg(F.array(*each).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def compared(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(n_common, n_same, n_only_old, n_only_new) of two tables by their keys."""
    both = old.select(*keys, F.col(value).alias("a"), F.lit(True).alias("x")).join(new.select(*keys, F.col(value).alias("b"), F.lit(True).alias("y")), keys, "full")
    return both.agg(F.count_if(F.col("x") & F.col("y")).alias("n_common"), F.count_if(F.col("x") & F.col("y") & F.col("a").eqNullSafe(F.col("b"))).alias("n_same"), F.count_if(F.col("y").isNull()).alias("n_only_old"), F.count_if(F.col("x").isNull()).alias("n_only_new"))


def side_by_side(cells: DataFrame, systems: list[str], value: str, width: int = 30) -> DataFrame:
    """A row a paper and field, a column a system, long texts cut."""
    short = F.when(F.length(value) > width, F.concat(F.left(F.col(value), F.lit(width)), F.lit("..."))).otherwise(F.col(value))
    return cells.groupBy("paper", "field").pivot("system", systems).agg(F.min(short))


def priority_label(rows: DataFrame, key: list[str], label: str, order: list[str]) -> DataFrame:
    """Over annotators the label that comes first in ``order``, and how many gave any."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(label))
    return rows.where(F.col(label).isNotNull()).groupBy(*key).agg(F.min_by(label, F.struct(F.when(place > 0, place).otherwise(len(order) + 1), F.col(label))).alias("label"), F.count("*").alias("annotators"))


def evaluator_stats(rows: DataFrame, label: str, points: dict[str, float], skipped: str = "SKIPPED") -> DataFrame:
    """Counts of each label and the mean of their points, skipped ones aside."""
    value = F.element_at(F.create_map(*[F.lit(x) for kv in points.items() for x in kv]), F.col(label))
    return rows.agg(F.count_if(F.col(label) != skipped).alias("n"), F.count_if(F.col(label) == skipped).alias("n_skipped"), *[F.count_if(F.col(label) == p).alias(f"n_{p.lower()}") for p in points], F.round(F.avg(F.when(F.col(label) != skipped, value)), 6).alias("mean"))


def retrieved(chunks: DataFrame, doc_id: str, keywords: list[str], sections: list[str], k: int = 5, most: int = 8) -> DataFrame:
    """Up to ``most`` chunks of each document: the k with most of the keywords (equal ones in order), then those of the sections, each once."""
    low, name = F.lower("text"), F.lower("section")
    hits = sum((low.contains(w.lower()).cast("int") for w in keywords), F.lit(0))
    near = F.lit(False)
    for s in sections:
        near = near | name.contains(s.lower()) | F.lit(s.lower()).contains(name)
    by_words = F.row_number().over(Window.partitionBy(doc_id).orderBy(F.desc("hits"), "chunk"))
    ranked = chunks.withColumn("hits", hits).withColumn("near", near).where("hits > 0 or near").withColumn("place", by_words)
    top = (F.col("place") <= k) & (F.col("hits") > 0)
    chosen = ranked.where(top | F.col("near")).withColumn("order", F.when(top, F.col("place")).otherwise(1_000_000 + F.col("chunk")))
    return chosen.withColumn("rank", F.row_number().over(Window.partitionBy(doc_id).orderBy("order"))).where(F.col("rank") <= most).select(doc_id, "chunk", "rank", "hits")


def presence(hits: Column, judged: Column, confidence: Column) -> Column:
    """PRESENT, IMPLICIT or ABSENT, from a group's keyword hits and a triage's word and its confidence."""
    return F.when((judged == "likely") & (hits > 0), "PRESENT").when((judged == "unlikely") & (hits == 0), "ABSENT").when((judged == "unlikely") & (confidence >= 0.8), "ABSENT").otherwise("IMPLICIT")


def agent_state(events: DataFrame, key: str, order: str, field: str, value: str, action: str) -> DataFrame:
    """(key, field, value): what an agent's log leaves: the first value that is set, or a later one once it was marked null; none if it ends null.

    Of values set at one place of the log the least counts.
    """
    null_at = F.max(F.when(F.col(action) == "null", F.col(order)))
    marks = events.groupBy(key, field).agg(F.coalesce(null_at, F.lit(-1)).alias("cut"))
    after = events.join(marks, [key, field]).where((F.col(action) == "set") & (F.col(order) > F.col("cut")))
    kept = after.groupBy(key, field).agg(F.min_by(value, F.struct(order, value)).alias(value))
    return marks.select(key, field).join(kept, [key, field], "left")


def without_errors(answers: DataFrame, errors: str, markers: list[str]) -> DataFrame:
    """Answers none of whose groups reports an error with a marker."""
    hit = F.exists(F.map_values(errors), lambda e: F.coalesce(F.lower(e).rlike("|".join(m.lower() for m in markers)), F.lit(False)))
    return answers.where(~F.coalesce(hit, F.lit(False)))


def judge_budget(cells: Column, price_in: Column, price_out: Column, tokens_in: int = 1000, tokens_out: int = 100) -> Column:
    """US$ of judging that many cells, at prices of a million tokens."""
    return F.round(cells * (tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out), 4)
