"""Canonical forms of licences, languages, dates, names, people, identifiers; built-in expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical licences and the spellings that stand for each, in order.
LICENCES = {
    "cc-by-4.0": ["cc-by-4.0", "cc by 4.0", "cc by-4.0", "creative commons 4.0", "creative commons attribution 4.0", "creative commons attribution 4.0 license", "creative commons attribution 4.0 international", "cc-by-4.0 international", "cc by 4.0 international"],
    "cc-by-3.0": ["cc-by-3.0", "cc by 3.0", "creative commons attribution 3.0", "creative commons attribution 3.0 unported"],
    "cc-by-sa-4.0": ["cc-by-sa-4.0", "cc by-sa 4.0", "cc by-sa-4.0", "cc-by-sa 4.0", "creative commons attribution-sharealike 4.0", "creative commons attribution sharealike 4.0", "creative commons attribution-sharealike 4.0 international"],
    "cc-by-nc-4.0": ["cc-by-nc-4.0", "cc by-nc 4.0", "cc by-nc-4.0", "creative commons attribution-noncommercial 4.0", "creative commons attribution noncommercial 4.0", "creative commons attribution-noncommercial 4.0 international"],
    "cc-by-nc-sa-4.0": ["cc-by-nc-sa-4.0", "cc by-nc-sa 4.0", "creative commons attribution-noncommercial-sharealike 4.0"],
    "cc0": ["cc0", "cc0 1.0", "cc0-1.0", "public domain", "creative commons zero", "cc zero"],
    "mit": ["mit", "mit license", "the mit license", "mit licence"],
    "apache-2.0": ["apache-2.0", "apache 2.0", "apache license 2.0", "apache license, version 2.0", "apache license version 2.0", "apache-2.0 license"],
    "gpl-3.0": ["gpl-3.0", "gplv3", "gnu gpl v3", "gnu general public license v3", "gnu general public license v3.0", "gpl 3.0", "gnu general public license version 3"],
    "gpl-2.0": ["gpl-2.0", "gplv2", "gnu gpl v2", "gpl 2.0"],
    "bsd-3-clause": ["bsd-3-clause", "bsd 3-clause", "3-clause bsd", "bsd 3 clause", "new bsd license", "modified bsd license"],
    "bsd-2-clause": ["bsd-2-clause", "bsd 2-clause", "simplified bsd license"],
    "custom": ["custom", "custom license", "other", "proprietary"],
    "unknown": ["unknown", "unknown license", "not specified"],
}
# Rewriting of licence names, in order.
LICENCE_REWRITES = [
    (r"https?://\S+", ""),
    (r"^\s+|\s+$", ""),
    (r"creative\s+commons\s+attribution\s*-?\s*non\s*-?\s*commercial\s*-?\s*share\s*-?\s*alike", "cc-by-nc-sa"),
    (r"creative\s+commons\s+attribution\s*-?\s*non\s*-?\s*commercial", "cc-by-nc"),
    (r"creative\s+commons\s+attribution\s*-?\s*share\s*-?\s*alike", "cc-by-sa"),
    (r"creative\s+commons\s+attribution", "cc-by"),
    (r"creative\s+commons\s+zero", "cc0"),
    (r"creative\s+commons", "cc-by"),
    (r"\s*(licen[sc]e|international|unported)\s*$", ""),
    (r"^the\s+", ""),
    (r"^\s+|\s+$", ""),
    (r"\bcc\s+by\b", "cc-by"),
    (r"\bcc-by\s+", "cc-by-"),
    (r"\bcc-by-sa\s+", "cc-by-sa-"),
    (r"\bcc-by-nc\s+", "cc-by-nc-"),
    (r"\bcc-by-nc-sa\s+", "cc-by-nc-sa-"),
    (r"\s+", "-"),
    (r"^-+|-+$", ""),
]
# Licences of the catalogue with their identifiers.
CATALOGUE = {"cc-by-4.0": "CC-BY-4.0", "cc by 4.0": "CC-BY-4.0", "cc-by-sa-4.0": "CC-BY-SA-4.0", "cc by-sa 4.0": "CC-BY-SA-4.0", "cc-by-nc-4.0": "CC-BY-NC-4.0", "cc by-nc 4.0": "CC-BY-NC-4.0", "cc-by-nc-sa-4.0": "CC-BY-NC-SA-4.0", "cc0-1.0": "CC0-1.0", "cc0": "CC0-1.0", "public domain": "CC0-1.0", "mit": "MIT", "mit license": "MIT", "apache-2.0": "Apache-2.0", "apache 2.0": "Apache-2.0"}
# Names of languages by their codes of two and three letters.
LANGUAGES = {"english": ["en", "eng"], "german": ["de", "deu"], "french": ["fr", "fra"], "spanish": ["es", "spa"], "italian": ["it", "ita"], "portuguese": ["pt", "por"], "dutch": ["nl", "nld"], "polish": ["pl", "pol"], "chinese": ["zh", "zho"], "japanese": ["ja", "jpn"]}
# Words that tell an organisation from a person.
ORGANISATION = r"(?i)\b(inc|corp|llc|ltd|university|institute|lab|labs|laboratory|research|foundation|google|openai|meta|microsoft|deepmind|anthropic|nvidia|allen|team|group|center|centre)\b"
WORD = r"([\p{L}\p{N}_]+)"


def spellings() -> list[tuple[str, str]]:
    """(spelling, canonical licence), the longest spelling first, equals in the order given."""
    return sorted(((v, c) for c, vs in LICENCES.items() for v in vs), key=lambda x: -len(x[0]))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def low(text: Column) -> Column:
    return F.lower(trim(text))


def mapped(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def licence(text: Column) -> Column:
    """Canonical licence of a name or address. Unknown names stay, rewritten; a name that begins one or that one begins is taken for it."""
    t = low(text)
    known = dict(spellings())
    cc = r"creativecommons\.org/licenses?/([\w-]+)/([\d.]+)"
    slug = F.regexp_extract(t, r"choosealicense\.com/licenses?/([\w.-]+)", 1)
    name = reduce(lambda x, r: F.regexp_replace(x, *r), LICENCE_REWRITES, t)
    near = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in spellings()]), lambda x: name.startswith(x["k"]) | x["k"].startswith(name))
    return (
        F.when(t.rlike(cc), F.concat(F.lit("cc-"), F.regexp_extract(t, cc, 1), F.lit("-"), F.regexp_extract(t, cc, 2)))
        .when(slug != "", F.coalesce(mapped(known, slug), slug))
        .otherwise(F.coalesce(mapped(known, name), F.get(near, F.lit(0))["v"], name))
    )


def catalogue_licence(text: Column) -> Column:
    return F.coalesce(mapped(CATALOGUE, low(text)), text)


def languages(text: Column) -> Column:
    """Sorted names of the languages of a list."""
    names = {code: name for name, codes in LANGUAGES.items() for code in codes}
    parts = F.transform(F.split(low(text), r"[,;/]\s*|\s+and\s+|\s+"), lambda p: F.regexp_replace(trim(p), r"\.+$", ""))
    return F.array_sort(F.array_distinct(F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.coalesce(mapped(names, p), p))))


def plain_name(text: Column) -> Column:
    """A data set's name without what stands in brackets, a closing kind word and joining signs."""
    t = trim(F.regexp_replace(low(text), r"\s*\(.*?\)\s*", " "))
    return F.translate(trim(F.regexp_replace(t, r"\s*(dataset|benchmark|corpus)\s*$", "")), "_-", "  ")


def names_match(a: Column, b: Column) -> Column:
    """Equality or containment, of the names or their plain forms; a short form in brackets inside the other; words of one among the other's."""
    x, y = low(a), low(b)
    px, py = plain_name(a), plain_name(b)
    wx, wy = F.regexp_extract_all(x, F.lit(WORD), 1), F.regexp_extract_all(y, F.lit(WORD), 1)

    def short(of, other):
        return F.exists(F.regexp_extract_all(of, F.lit(r"\(([A-Z]{2,})\)"), 1), lambda s: other.contains(F.lower(s)))

    within = lambda p, q: (F.size(p) > 0) & (F.size(F.array_except(p, q)) == 0)
    return x.contains(y) | y.contains(x) | px.contains(py) | py.contains(px) | short(a, y) | short(b, x) | within(wx, wy) | within(wy, wx)


def plain_text(text: Column) -> Column:
    """Lower case, signs as blanks, one blank between words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def collapsed(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def people(text: Column) -> Column:
    """Sorted distinct names of a list of people, without organisations, signs and names of under three letters."""
    parts = F.transform(F.split(F.lower(text), r"[,;]|\band\b"), lambda p: F.trim(F.regexp_replace(p, r"[^\p{L}\p{N}_\s]", "")))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda p: (F.length(p) > 2) & ~p.rlike(ORGANISATION))))


def creators(text: Column) -> Column:
    """Array of (kind, name): people of a list, or the whole as an organisation or a person."""
    t = trim(text)
    both = r"^([^()]+)\((.+)\)$"
    outer, inner = trim(F.regexp_extract(t, both, 1)), trim(F.regexp_extract(t, both, 2))
    t = F.when(outer == "", t).when(inner.contains(",") & ~outer.contains(","), inner).otherwise(outer)
    parts = F.filter(F.transform(F.split(t, r",|;|\band\b"), trim), lambda p: p != "")
    each = F.transform(parts, lambda p: F.struct(F.lit("Person").alias("kind"), p.alias("name")))
    kind = F.when(t.rlike(ORGANISATION), "Organization").otherwise("Person")
    return F.when((F.size(parts) > 1) & ~F.exists(parts, lambda p: p.rlike(ORGANISATION)), each).otherwise(F.array(F.struct(kind.alias("kind"), t.alias("name"))))


def arxiv_id(text: Column) -> Column:
    """A paper's number without its version."""
    found = F.regexp_extract(text, r"(\d{4}\.\d{4,5})(v\d+)?", 1)
    return F.when(found != "", found)


def hub_id(address: Column) -> Column:
    """``org_name`` of a hub's address or of ``org/name``."""
    return F.regexp_replace(F.regexp_replace(trim(address), r"^https?://[^/]+/(datasets/)?", ""), "^([^/]*)/", "$1_")


def safe_id(text: Column) -> Column:
    """An identifier of at most 64 letters, digits, ``_`` and ``-``; a longer one ends in a digest of the original."""
    t = F.regexp_replace(F.replace(text, F.lit("/"), F.lit("__")), "[^a-zA-Z0-9_-]", "_")
    return F.when(F.length(t) > 64, F.concat(F.substring(t, 1, 51), F.lit("_"), F.substring(F.md5(text.cast("binary")), 1, 12))).otherwise(t)


def rating(text: Column) -> Column:
    """The leading digit from 1 to 3."""
    found = F.regexp_extract(text, r"^\s*([123])", 1)
    return F.when(found != "", found.cast("int"))


def dates_match(a: Column, b: Column) -> Column:
    """Whether both have the same year; null where one has none or they differ, as that decides nothing."""
    from scholium.functions.scalars import year

    return F.when(year(a) == year(b), True)


def plausible(kind: str, text: Column) -> Column:
    """Whether a value looks like a url, a licence or a date."""
    if kind == "url":
        return text.rlike(r"^https?://\S+\.\S+")
    if kind == "date":
        return text.rlike(r"\b(19|20)\d{2}\b")
    return text.rlike(r"(?i)\b(cc|mit|apache|gpl|bsd|public domain|odc|licen[sc]e)")
