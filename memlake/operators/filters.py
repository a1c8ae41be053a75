"""Predicates over memories and their edges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field_filter(name: str, wanted: Any) -> Column | None:
    """Equality; membership for a list (compared as strings); contains-any for ``{"containsAny": [...]}``
    over a JSON array.  Other objects, and None, filter nothing."""
    column = F.col(name)
    if wanted is None:
        return None
    if isinstance(wanted, Mapping):
        if set(wanted) != {"containsAny"}:
            return None
        values = F.array(*[F.lit(str(v)) for v in wanted["containsAny"]]).cast("array<string>")
        return F.arrays_overlap(F.from_json(column, "array<string>"), values)
    if isinstance(wanted, (list, tuple, set)):
        return column.cast("string").isin([str(v) for v in wanted])
    return column == F.lit(wanted)


def memory_filters(rows: DataFrame, filters: Mapping[str, Any] = {}, before: int | None = None, after: int | None = None) -> DataFrame:
    """Field filters and an inclusive range of event_time; a null time fails any bound."""
    for name, wanted in filters.items():
        if (test := field_filter(name, wanted)) is not None:
            rows = rows.where(test)
    if before is not None:
        rows = rows.where(F.col("event_time") <= before)
    if after is not None:
        rows = rows.where(F.col("event_time") >= after)
    return rows


def having_tags(rows: DataFrame, tagged: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Rows with any of the tags."""
    some = tagged.where(F.col("out_id").isin(list(tags))).select(F.col("in_id").alias("id"))
    return rows.join(some, "id", "left_semi")


def owned_by(rows: DataFrame, owned: DataFrame, domains: Sequence[str]) -> DataFrame:
    """Rows owned by any of the domains; a row without owner is invisible."""
    return having_tags(rows, owned, domains)


def get_memories(
    memory: DataFrame, owned: DataFrame, domains: Sequence[str], since: int | None = None,
    attributes: Mapping[str, str] = {}, limit: int | None = None, tagged: DataFrame | None = None, tags: Sequence[str] = (),
) -> DataFrame:
    """Owner, time of ownership and attribute equality (as text); then the limit; then tags, in that order."""
    owners = owned.where(F.col("out_id").isin(list(domains)))
    if since is not None:
        owners = owners.where(F.col("owned_at") >= since)
    for key, value in attributes.items():
        owners = owners.where(F.get_json_object("attributes", f"$.{key}") == F.lit(str(value)))
    rows = memory.join(owners.select(F.col("in_id").alias("id")), "id", "left_semi")
    if limit is not None:
        rows = rows.orderBy("created_at", "id").limit(limit)
    return having_tags(rows, tagged, tags) if tags and tagged is not None else rows


def still_valid(attributes: Column, now_ms: int) -> Column:
    """Not superseded, not decomposed, not past validUntil; missing attributes are valid."""
    flag = lambda k: F.coalesce(F.get_json_object(attributes, f"$.{k}") == "true", F.lit(False))
    until = F.get_json_object(attributes, "$.validUntil").cast("bigint")
    return attributes.isNull() | (~flag("superseded") & ~flag("decomposed") & F.coalesce(until >= now_ms, F.lit(True)))


def audience_matches(attributes: Column, wanted: str | None) -> Column:
    """No request matches all; else the audience (one or an array) must hold it."""
    if wanted is None:
        return F.lit(True)
    given = F.get_json_object(attributes, "$.audience")
    listed = F.array_contains(F.from_json(given, "array<string>"), wanted)
    return F.coalesce(listed, given == wanted, F.lit(False))


def as_of(claims: DataFrame, at_ms: int | None) -> DataFrame:
    """Claims valid at a time, or (None) the open ones; a null valid_to is open."""
    if at_ms is None:
        return claims.where("valid_to is null")
    return claims.where((F.col("valid_from") <= at_ms) & (F.col("valid_to").isNull() | (F.col("valid_to") > at_ms)))


def contains_any(text: Column, parts: Sequence[str]) -> Column:
    """Case-insensitive substring of any; parts are plain text, not patterns."""
    out = F.lit(False)
    for part in parts:
        out = out | F.lower(text).contains(part.lower())
    return out


def differs(column: Column, value: Any) -> Column:
    """Null-safe inequality: a null differs from every value but null."""
    return ~column.eqNullSafe(value)
