"""Records as documents: JSON-LD, review, checks, enrichment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholium.functions import fields as S
from scholium.functions import names as N
from scholium.functions import nulls
from scholium.functions.scalars import iso_date

# Context and version of the documents.
CONTEXT = {"@language": "en", "@vocab": "https://schema.org/", "sc": "https://schema.org/", "cr": "http://mlcommons.org/croissant/", "rai": "http://mlcommons.org/croissant/RAI/", "dct": "http://purl.org/dc/terms/", "conformsTo": "dct:conformsTo"}
VERSION = "http://mlcommons.org/croissant/1.1"
CORE = S.CANONICAL[:10]


def filled(record: Column, key: str) -> Column:
    """A field's informative value, else null."""
    v = F.element_at(record, F.lit(key))
    return F.when(v.isNotNull() & ~nulls.unfilled(v), v)


def jsonld(record: Column) -> Column:
    """The JSON-LD text of a map from field to value; only informative values are in it."""
    creator = filled(record, "creator")
    people = F.when(creator.isNotNull(), F.transform(N.creators(creator), lambda p: F.struct(p["kind"].alias("@type"), p["name"].alias("name"))))
    publisher = filled(record, "publisher")
    live = F.lower(F.trim(F.element_at(record, F.lit("isLiveDataset"))))

    def parts(author: Column) -> list[Column]:
        return [
            F.struct(*[F.lit(v).alias(k) for k, v in CONTEXT.items()]).alias("@context"),
            F.lit("sc:Dataset").alias("@type"),
            F.lit(VERSION).alias("conformsTo"),
            *[filled(record, k).alias(k) for k in ("name", "description", "license", "url")],
            F.when(publisher.isNotNull(), F.struct(F.lit("Organization").alias("@type"), N.trim(publisher).alias("name"))).alias("publisher"),
            iso_date(filled(record, "datePublished")).alias("datePublished"),
            filled(record, "inLanguage").alias("inLanguage"),
            filled(record, "citeAs").alias("cr:citeAs"),
            author.alias("creator"),
            F.when(live.isin("yes", "true"), True).when(live.isin("no", "false"), False).alias("cr:isLiveDataset"),
            *[filled(record, k).alias(k) for k in S.RAI],
        ]

    one, many = (F.to_json(F.struct(*parts(x))) for x in (people[0], people))
    return F.when(F.size(people) == 1, one).otherwise(many)


def host_fields(document: Column) -> Column:
    """Fields that a host's JSON-LD gives, under their short names; names of objects, the first of alternatives."""
    at = lambda *paths: F.coalesce(*[F.get_json_object(document, p) for p in paths])
    pairs = {
        "name": at("$.name"), "description": at("$.description"), "url": at("$.url", "$['@id']"), "license": at("$.license.name", "$.license"), "creator": at("$.creator.name", "$.creator[0].name", "$.creator"),
        "publisher": at("$.publisher.name", "$.publisher"), "datePublished": at("$.datePublished"), "inLanguage": at("$.inLanguage[0]", "$.inLanguage"), "citeAs": at("$['cr:citeAs']", "$.citeAs"), "isLiveDataset": at("$['cr:isLiveDataset']", "$.isLiveDataset"),
    }
    rai = {k: at(f"$['{k}']") for k in S.RAI}
    return F.map_filter(F.create_map(*[x for k, v in (pairs | rai).items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())


def reviewed(extracted: Column, typed: Column) -> Column:
    """Values after review: as extracted where the typed text is the same, else as typed, null where it was cleared."""
    shown = lambda v: F.coalesce(N.trim(v), F.lit(""))
    return F.map_zip_with(extracted, typed, lambda _, old, new: F.when(shown(new) == shown(old), old).otherwise(F.nullif(shown(new), F.lit(""))))


def edited(extracted: Column, typed: Column) -> Column:
    """Fields that review changed, in order."""
    shown = lambda v: F.coalesce(N.trim(v), F.lit(""))
    marks = F.map_zip_with(extracted, typed, lambda _, old, new: shown(new) != shown(old))
    return F.array_sort(F.map_keys(F.map_filter(marks, lambda _, m: m)))


def kept_evidence(evidence: Column, changed: Column) -> Column:
    """Evidence of the fields that review left alone."""
    return F.map_filter(evidence, lambda k, _: ~F.array_contains(changed, k))


def coverage(record: Column) -> Column:
    """(core, rai): how many fields of each kind are informative."""
    found = F.map_keys(F.map_filter(record, lambda _, v: v.isNotNull() & ~nulls.unfilled(v)))
    return F.struct(F.size(F.array_intersect(found, F.array(*map(F.lit, CORE)))).alias("core"), F.size(F.array_intersect(found, F.array(*map(F.lit, S.RAI)))).alias("rai"))


def enriched(record: Column, found: Column) -> Column:
    """A record whose empty fields take what a catalogue gives."""
    return F.map_zip_with(record, found, lambda _, old, new: F.when(nulls.detail_null(old), new).otherwise(old))


def empty_but_expected(record: Column, expected: Column) -> Column:
    """Expected fields without a value, in order."""
    return F.array_sort(F.filter(expected, lambda k: nulls.detail_null(F.element_at(record, k))))


def complete(record: Column) -> Column:
    """A map with every field of the schema; those that are not there are null."""
    return F.map_from_entries(F.transform(F.array(*map(F.lit, S.CANONICAL)), lambda k: F.struct(k, F.element_at(record, k))))


def schema_errors(record: Column) -> Column:
    """(missing, extra, spaced): fields that lack, that the schema does not know, and whose names have white space at an end."""
    keys, known = F.map_keys(record), F.array(*map(F.lit, sorted(S.CANONICAL)))
    return F.struct(F.array_sort(F.array_except(known, keys)).alias("missing"), F.array_sort(F.array_except(keys, known)).alias("extra"), F.array_sort(F.filter(keys, lambda k: k != N.trim(k))).alias("spaced"))


def required_missing(document: Column, required: list[str]) -> Column:
    """Required fields that a JSON-LD text lacks or leaves empty."""
    found = F.array(*[F.when(F.trim(F.coalesce(F.get_json_object(document, f"$['{k}']"), F.lit(""))) == "", k) for k in required])
    return F.array_compact(found)


def flat(value: Column) -> Column:
    """A nested JSON value as text: an object's name, else its id; a list's values with commas between; else the value itself."""
    name = F.coalesce(F.get_json_object(value, "$.name"), F.get_json_object(value, "$['@id']"))
    items = F.from_json(value, "array<string>")
    texts = F.transform(items, lambda x: F.coalesce(F.get_json_object(x, "$.name"), x))
    return F.when(value.startswith("{"), name).when(value.startswith("["), F.array_join(texts, ", ")).otherwise(value)


def payload(answer: Column) -> Column:
    """The JSON object of fields in an answer: under ``extraction``, under ``fields``, or the whole."""
    inner = [F.get_json_object(answer, f"$.{k}") for k in ("extraction", "fields")]
    return F.coalesce(*[F.when(x.startswith("{"), x) for x in inner], answer)
