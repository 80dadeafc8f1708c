"""Column expressions for canonical values, null tests and text similarity; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Licence patterns, the first that matches anywhere decides.
SPDX = (
    ("MIT", r"\bmit license\b|\bmit\b"),
    ("Apache-2.0", r"apache\s*(license)?\s*(v|version)?\s*2(\.0)?|apache-2"),
    ("BSD-3-Clause", r"bsd[\s\-]*3[\s\-]*clause|new bsd|modified bsd"),
    ("BSD-2-Clause", r"bsd[\s\-]*2[\s\-]*clause|simplified bsd"),
    ("GPL-3.0", r"gpl[\s\-]*(v|version)?\s*3|gnu general public license.*3"),
    ("GPL-2.0", r"gpl[\s\-]*(v|version)?\s*2|gnu general public license.*2"),
    ("LGPL-3.0", r"lgpl[\s\-]*(v|version)?\s*3|lesser general public license.*3"),
    ("AGPL-3.0", r"agpl[\s\-]*(v|version)?\s*3|affero.*3"),
    ("CC0-1.0", r"cc0|creative commons zero|public domain dedication"),
    ("CC-BY-4.0", r"cc[\s\-]*by[\s\-]*4(\.0)?|creative commons attribution(?!.*(share|noncommercial|noderiv)).*4"),
    ("CC-BY-SA-4.0", r"cc[\s\-]*by[\s\-]*sa[\s\-]*4(\.0)?|attribution[\s\-]*sharealike\s*4"),
    ("CC-BY-NC-4.0", r"cc[\s\-]*by[\s\-]*nc[\s\-]*4(\.0)?|attribution[\s\-]*noncommercial\s*4"),
    ("CC-BY-NC-SA-4.0", r"cc[\s\-]*by[\s\-]*nc[\s\-]*sa[\s\-]*4(\.0)?"),
    ("CC-BY-ND-4.0", r"cc[\s\-]*by[\s\-]*nd[\s\-]*4(\.0)?"),
    ("CC-BY-3.0", r"cc[\s\-]*by[\s\-]*3(\.0)?"),
    ("ODbL-1.0", r"open database license|odbl"),
    ("ODC-BY-1.0", r"odc[\s\-]*by"),
    ("OpenRAIL", r"openrail|responsible ai license"),
    ("Llama-2", r"llama[\s\-]*2.*license|llama 2 community"),
    ("Llama-3", r"llama[\s\-]*3.*license|llama 3 community"),
)
NULL_WORDS = ("", "null", "none", "n/a", "na", "not specified", "not mentioned", "unknown")


def first_rule(rules) -> Column:
    """Label of the first (label, condition) that holds, else null."""
    chain = None
    for label, rule in rules:
        chain = (F if chain is None else chain).when(rule, label)
    return chain


def spdx(text: Column) -> Column:
    return first_rule([(name, text.rlike("(?iU)" + pattern)) for name, pattern in SPDX])


def year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\b(19|20)\d{2}\b", 0), F.lit(""))


def iso_date(text: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD as they are; English month names, long or short, with or without a day; else the year; else null."""
    t = F.trim(text)
    known = [("MMMM yyyy", "yyyy-MM"), ("MMM yyyy", "yyyy-MM"), ("MMMM d, yyyy", "yyyy-MM-dd"), ("MMM d, yyyy", "yyyy-MM-dd"), ("d MMMM yyyy", "yyyy-MM-dd"), ("d MMM yyyy", "yyyy-MM-dd")]
    return F.coalesce(F.when(t.rlike(r"^\d{4}(-\d{2}){0,2}$"), t), *[F.date_format(F.try_to_timestamp(t, F.lit(f)), out) for f, out in known], year(t))


def normal_url(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "/+$", ""), "^https?://", "")


def normal_boolean(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin("yes", "true", "1"), "true").when(t.isin("no", "false", "0"), "false").otherwise(t)


def is_null_text(text: Column) -> Column:
    return text.isNull() | F.lower(F.trim(text)).isin(*NULL_WORDS)


def gram_words(text: Column) -> Column:
    """Words of a-z and 0-9 in lower case; anything else parts them."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda x: x != "")


def slices(words: Column, n: int) -> Column:
    """The n words of every place; none if there are fewer (a sequence to a smaller end would count down)."""
    some = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.slice(words, i, n))
    return F.filter(some, lambda g: F.size(g) == n)


def grams(words: Column, n: int) -> Column:
    """Distinct n-grams as text."""
    return F.array_distinct(F.transform(slices(words, n), lambda g: F.array_join(g, " ")))


def token_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1))


def token_precision(a: Column, b: Column) -> Column:
    """Share of the first token set that the second has: both empty 1, one empty 0."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two token sets: both empty 1, one empty 0."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def set_cosine(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a).cast("double") * F.size(b)))


def odd_share(text: Column) -> Column:
    """Share of characters that are no letter, digit, blank or usual sign; 1 for no text."""
    bad = F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s.,;:!?'\"()\-\[\]{}/\\@#$%&*+=<>_|~`]", ""))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 1.0).otherwise(bad / F.length(text))


def verdict_score(verdict: Column) -> Column:
    """1, 2, 3 as 1, 0.5, 0."""
    return (3 - verdict) / 2.0


def cohens_h(p: Column, q: Column) -> Column:
    return 2 * F.asin(F.sqrt(p)) - 2 * F.asin(F.sqrt(q))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of a share in per cent, within 0 and 100."""
    p, d = hits / n, 1 + z * z / n
    middle = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.greatest(F.lit(0.0), 100 * (middle - half)), F.least(F.lit(100.0), 100 * (middle + half))
