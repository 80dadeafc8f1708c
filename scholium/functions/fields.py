"""Scores of single fields: what kind a field is, and how an answer is held against gold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholium.functions import names as N
from scholium.functions import nulls
from scholium.functions import scalars as S

# The fields of a record by the way they are scored, and their names without prefix.
CONSTRAINED = ["sc:name", "sc:url", "sc:license", "sc:publisher", "sc:datePublished", "sc:inLanguage", "cr:isLiveDataset"]
SHORT_TEXT = ["sc:creator", "cr:citeAs", "sc:description"]
RAI = ["rai:dataCollection", "rai:dataCollectionType", "rai:dataCollectionMissingData", "rai:dataCollectionRawData", "rai:dataCollectionTimeframe", "rai:dataImputationProtocol", "rai:dataManipulationProtocol", "rai:dataPreprocessingProtocol", "rai:dataAnnotationProtocol", "rai:dataAnnotationPlatform", "rai:dataAnnotationAnalysis", "rai:annotationsPerItem", "rai:annotatorDemographics", "rai:machineAnnotationTools", "rai:dataReleaseMaintenancePlan", "rai:personalSensitiveInformation", "rai:dataSocialImpact", "rai:dataBiases", "rai:dataLimitations", "rai:dataUseCases"]
FIELDS = CONSTRAINED + SHORT_TEXT + RAI
PREFIXED = {"sc:name": "name", "sc:description": "description", "sc:url": "url", "sc:license": "license", "sc:creator": "creator", "sc:publisher": "publisher", "sc:datePublished": "datePublished", "sc:inLanguage": "inLanguage", "cr:citeAs": "citeAs", "cr:isLiveDataset": "isLiveDataset", "sc:citeAs": "citeAs", "sc:isLiveDataset": "isLiveDataset", "cr:name": "name", "cr:description": "description"}
CANONICAL = ["name", "description", "url", "license", "creator", "publisher", "datePublished", "inLanguage", "citeAs", "isLiveDataset", *RAI]


def kind(field: Column) -> Column:
    return F.when(field.isin(CONSTRAINED), "constrained").when(field.isin(SHORT_TEXT), "short_text").when(field.isin(RAI), "rai").otherwise("unknown")


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(N.WORD), 1))


def exact(a: Column, b: Column) -> Column:
    """Equality without case and white space at the ends."""
    return (N.low(a) == N.low(b)).cast("double")


def contains_either(a: Column, b: Column) -> Column:
    """Whether one text has the other, white space collapsed; blanks have nothing."""
    x, y = N.collapsed(a), N.collapsed(b)
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x))


def constrained(field: Column, answer: Column, gold: Column) -> Column:
    """1 if both have one canonical form, by the field's rule."""
    ty, tg = S.year(answer), S.year(gold)
    pa, pg = tokens(answer), tokens(gold)
    least = F.least(F.size(pa), F.size(pg))
    same = (
        F.when(field == "sc:name", N.names_match(answer, gold))
        .when(field == "sc:license", N.licence(answer) == N.licence(gold))
        .when(field == "sc:inLanguage", N.languages(answer) == N.languages(gold))
        .when((field == "sc:datePublished") & ty.isNotNull() & tg.isNotNull(), ty == tg)
        .when(field == "cr:isLiveDataset", S.normal_boolean(N.trim(answer)) == S.normal_boolean(N.trim(gold)))
        .when(field == "sc:url", S.normal_url(N.trim(answer)) == S.normal_url(N.trim(gold)))
        .when((field == "sc:publisher") & (least > 0), F.size(F.array_intersect(pa, pg)) >= 0.5 * least)
        .otherwise(N.low(answer) == N.low(gold))
    )
    return same.cast("double")


def score(field: Column, answer: Column, gold: Column, judged: Column, null_rule=nulls.field_null, correct_null: str = "drop") -> Column:
    """(score, metric): an answer against gold; no score where there is nothing to judge.

    Gold without a value: no answer is skipped (or 1 with ``correct_null="credit"``), any answer is a hallucination. No answer to
    a value is missing. Else the field's kind decides; ``judged`` is the score of a long text, which is skipped without one.
    """
    none, blank = null_rule(gold), nulls.blank(answer)
    k = kind(field)
    p, g = N.trim(answer), N.trim(gold)

    def out(x, metric):
        return F.struct(F.lit(x).cast("double").alias("score") if not isinstance(x, Column) else x.cast("double").alias("score"), F.lit(metric).alias("metric"))

    return (
        F.when(none & blank, out(1.0 if correct_null == "credit" else None, "correct_null"))
        .when(none, out(0.0, "hallucination"))
        .when(blank, out(0.0, "missing"))
        .when(k == "constrained", out(constrained(field, p, g), "exact_match"))
        .when(k == "short_text", out(S.token_f1(tokens(p), tokens(g)), "token_f1"))
        .when(k == "rai", out(judged, "judge"))
        .otherwise(out(0.0, "unknown"))
    )


def judge_both(forward: Column, backward: Column) -> Column:
    """Verdicts given in both orders: none if one is none, 1 if the first is 1, else the worse."""
    return F.when(forward.isNull() | backward.isNull(), None).when(forward == 1, 1).otherwise(F.greatest(forward, backward))


def resolved(record: Column, field: Column, canonical: bool = True) -> Column:
    """A field's value in a map, under its name or its short one. Canonically a name that is there with null hides the short one."""
    short = F.element_at(F.split(field, ":"), -1)
    if canonical:
        return F.when(F.map_contains_key(record, field), F.element_at(record, field)).otherwise(F.element_at(record, short))
    return F.coalesce(F.element_at(record, field), F.element_at(record, short), F.element_at(record, F.concat(F.lit("rai:"), short)))


def short_names(record: Column) -> Column:
    """A map with the prefixes of core fields taken off; of two keys that fall together the last stays."""
    renamed = F.transform(F.map_entries(record), lambda e: F.struct(F.coalesce(N.mapped(PREFIXED, e["key"]), e["key"]).alias("key"), e["value"].alias("value")))
    n = F.size(renamed)
    last = F.filter(renamed, lambda e, i: ~F.exists(F.slice(renamed, i + 2, n), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def confidence(value: Column, evidence: Column, enriched: Column, unlikely: Column) -> Column:
    """(confidence, status, source) of a value: 0.8, 0.15 more with evidence, 0.7 if looked up elsewhere, at most 0.5 where none was expected."""
    has = ~nulls._low(evidence).isin("", "null", "none")
    c = F.when(enriched, 0.7).when(has, 0.95).otherwise(0.8)
    c = F.when(nulls.detail_null(value), 0.0).when(unlikely, F.least(c, F.lit(0.5))).otherwise(c)
    status = F.when(nulls.detail_null(value), "NULL").when(c >= 0.7, "VERIFIED").when(c >= 0.4, "UNCERTAIN").otherwise("LOW_CONFIDENCE")
    source = F.when(nulls.detail_null(value), "absent").when(enriched, "enrichment").otherwise("extraction")
    return F.struct(c.alias("confidence"), status.alias("status"), source.alias("source"))
