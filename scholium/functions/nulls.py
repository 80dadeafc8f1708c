"""What counts as no value. The dialects differ on purpose: each consumer of a corpus has its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words and openings that each dialect takes for a missing value, as published.
GOLD_WORDS = ["null", "none", "n/a", "na", "unknown", "not disclosed", "not found", "not mentioned", "not specified", "not applicable", "not available"]
GOLD_PHRASES = ["not found in paper", "not mentioned in paper", "not specified in paper"]
GOLD_PATTERN = r"^(\[null|(null|n/?a|none|unknown)[\s.,;:-]*$|not (disclosed|found|mentioned|specified|applicable|available)\b)"
FIELD_OPENINGS = ["[null", "[na]", "[n/a"]
FILLED_WORDS = ["not mentioned", "not available", "n/a", "unknown", "not specified", "not provided", "null"]
NULLISH_WORDS = ["null", "none", "n/a", "na", "not mentioned", "not applicable", "unknown"]
DETAIL_WORDS = ["null", "none", "n/a", "not applicable", "[null]", "[null - not found in paper]"]
TRUTH_WORDS = ["none", "null", "[null]"]


def _low(value: Column) -> Column:
    """Lower case without white space at the ends; null as empty."""
    return F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), r"^\s+|\s+$", ""))


def _opens(text: Column, openings: list[str]) -> Column:
    found = F.lit(False)
    for x in openings:
        found = found | text.startswith(x)
    return found


def _has(text: Column, phrases: list[str]) -> Column:
    found = F.lit(False)
    for x in phrases:
        found = found | text.contains(x)
    return found


def blank(value: Column) -> Column:
    """No answer at all; a text that says so is an answer."""
    return _low(value) == ""


def gold_null(value: Column) -> Column:
    """The scorer's rule: the whole value is a marker, so a name that begins like one is a value."""
    t = _low(value)
    return (t == "") | t.isin(GOLD_WORDS) | t.rlike(GOLD_PATTERN) | _has(t, GOLD_PHRASES) | _opens(t, ["[null", "[na", "[n/a"])


def field_null(value: Column) -> Column:
    """The field scorer's rule: words, openings in brackets and phrases anywhere."""
    t = _low(value)
    return (t == "") | t.isin(GOLD_WORDS) | _opens(t, FIELD_OPENINGS) | _has(t, GOLD_PHRASES)


def coverage_null(value: Column) -> Column:
    """The coverage count's rule."""
    t = _low(value)
    return (t == "") | t.isin("not specified", "unknown") | t.startswith("[null")


def unfilled(value: Column) -> Column:
    """The assembler's rule: no informative value."""
    t = _low(value)
    return (t == "") | t.isin(FILLED_WORDS)


def nullish(value: Column) -> Column:
    """The agent's rule for what becomes a real null."""
    t = _low(value)
    return (t == "") | t.isin(NULLISH_WORDS)


def detail_null(value: Column) -> Column:
    """The detail view's rule."""
    t = _low(value)
    return (t == "") | t.isin(DETAIL_WORDS)


def truth_null(value: Column) -> Column:
    """The label builder's rule."""
    t = _low(value)
    return (t == "") | t.isin(TRUTH_WORDS)


def bracket_null(value: Column) -> Column:
    """The development split's rule: empty or an opening bracket with null."""
    t = _low(value)
    return (t == "") | t.startswith("[null")


DIALECTS = {"gold": gold_null, "field": field_null, "coverage": coverage_null, "unfilled": unfilled, "nullish": nullish, "detail": detail_null, "truth": truth_null, "bracket": bracket_null}


def pair_class(gold: Column, answer: Column, rule=gold_null) -> Column:
    """correct_null, hallucination, miss or compare."""
    none = rule(gold)
    return F.when(none & blank(answer), "correct_null").when(none, "hallucination").when(blank(answer), "miss").otherwise("compare")


def coerced(record: Column) -> Column:
    """A map whose nullish values are null."""
    return F.transform_values(record, lambda _, v: F.when(~nullish(v), v))
