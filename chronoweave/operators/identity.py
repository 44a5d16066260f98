"""Deterministic identities of facts, slots, mentions and references."""

from __future__ import annotations

import hashlib
import json
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from chronoweave.sources.tables import trimmed


def qualifier_hash_of(text: str | None) -> str:
    """BLAKE2b-64 of canonical JSON; empty for no, empty or unreadable qualifiers."""
    try:
        value = json.loads(text) if text and text.strip() else None
    except ValueError:
        return ""
    if not value:
        return ""
    canonical = json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.blake2b(canonical.encode(), digest_size=8).hexdigest()


@F.pandas_udf(StringType())
def qualifier_hash(text: pd.Series) -> pd.Series:
    known = {t: qualifier_hash_of(t) for t in text.dropna().unique()}
    return pd.Series([known.get(t, "") if t is not None else "" for t in text])


def fact_key(group: Column, subj: Column, pred: Column, obj: Column, qhash: Column) -> Column:
    """``group::subject::predicate::object``, and the qualifier hash if there is one."""
    key = F.concat_ws("::", trimmed(group), trimmed(subj), F.lower(trimmed(pred)), trimmed(obj))
    return F.when(F.coalesce(qhash, F.lit("")) != "", F.concat_ws("::", key, qhash)).otherwise(key)


def slot_key(group: Column, subj: Column, canonical: Column, qhash: Column) -> Column:
    return F.concat_ws("::", group, subj, F.lower(canonical), F.coalesce(qhash, F.lit("")))


def symmetric(a: Column, b: Column) -> tuple[Column, Column]:
    """Endpoints of a symmetric relation in order; left alone if either is empty."""
    both = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return F.when(both, F.least(a, b)).otherwise(a), F.when(both, F.greatest(a, b)).otherwise(b)


def mention_id(group: Column, episode: Column, entity: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", group, episode, entity), 256)


def memory_ref_key(group: Column, actor: Column, fact: Column, role: Column, episode: Column) -> Column:
    return F.concat_ws("::", *[F.coalesce(c, F.lit("")) for c in (group, actor, fact, role, episode)])


def self_id(prefix: str, group: Column, value: Column, slug: Column) -> Column:
    return F.concat_ws("_", F.lit(prefix), F.substring(slug, 1, 80), F.substring(F.sha1(F.concat(group, F.lit("\0"), value)), 1, 12))


@F.pandas_udf(StringType())
def import_id(text: pd.Series) -> pd.Series:
    """UUIDv5 in the URL namespace."""
    return text.map(lambda t: None if t is None else str(uuid.uuid5(uuid.NAMESPACE_URL, t)))


@F.pandas_udf(StringType())
def name_key(name: pd.Series) -> pd.Series:
    """Full case folding, blanks collapsed."""
    return name.map(lambda n: None if n is None else " ".join(n.casefold().split()))
