"""Records as maps from field to value: checks, merging and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(record: Column) -> Column:
    return F.map_filter(record, lambda _, v: v.isNotNull() & (F.trim(v) != ""))


def missing(record: Column, required: list[str]) -> Column:
    """Required fields without a value, in the order given."""
    return F.array_except(F.array(*map(F.lit, required)), F.map_keys(filled(record)))


def extra(record: Column, known: list[str]) -> Column:
    """Keys that the schema does not know, in order."""
    return F.array_sort(F.array_except(F.map_keys(record), F.array(*map(F.lit, known))))


def merged(ours: Column, host: Column) -> Column:
    """Values of both; those that the host fills win."""
    return F.map_zip_with(filled(ours), filled(host), lambda _, a, b: F.coalesce(b, a))


def added(ours: Column, host: Column) -> Column:
    """Fields that only ours fills."""
    return F.array_sort(F.array_except(F.map_keys(filled(ours)), F.map_keys(filled(host))))


def kept(ours: Column, host: Column) -> Column:
    """Fields that both fill, where the host's value stays."""
    return F.array_sort(F.array_intersect(F.map_keys(filled(ours)), F.map_keys(filled(host))))


def document(record: Column) -> Column:
    """JSON of the filled fields."""
    return F.to_json(filled(record))
