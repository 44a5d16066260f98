"""Tolerant readings of loosely typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LAYOUTS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS][XXX]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS][XXX]", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd")


def iso_time(text: Column) -> Column:
    """Instant of a text in one of the usual layouts, UTC without a zone; null on failure."""
    t = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(p)) for p in _LAYOUTS])


def activation_time(text: Column) -> Column:
    """Like iso_time, and numbers count seconds since 1970."""
    return F.coalesce(F.timestamp_seconds(F.trim(text).try_cast("double")), iso_time(text))


def iso_text(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def truthy(text: Column) -> Column:
    """Truth of a JSON scalar: true, numbers but 0, and texts that say yes."""
    t = F.lower(F.trim(F.regexp_replace(text, '^"|"$', "")))
    return F.coalesce(F.coalesce(t.isin("true", "yes", "y", "on"), F.lit(False)) | F.coalesce(t.try_cast("double") != 0, F.lit(False)), F.lit(False))


def number(text: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(default))


def string_list(text: Column) -> Column:
    """A JSON list of texts, or one text, as a list without blanks."""
    as_list = F.from_json(F.when(F.trim(text).startswith("["), text), "array<string>")
    one = F.when(F.trim(text) != "", F.array(F.trim(text))).otherwise(F.array().cast("array<string>"))
    return F.coalesce(F.filter(as_list, lambda x: F.trim(x) != ""), one)


def unfenced(text: Column) -> Column:
    """JSON without a code fence around it."""
    return F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*|\s*```$", "")


def merged(old: Column, new: Column) -> Column:
    """Two string maps as one; the new value stands. A null map is empty."""
    keep = F.map_filter(old, lambda k, v: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.map_concat(keep, new))
