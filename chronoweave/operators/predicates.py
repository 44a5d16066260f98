"""Predicates over facts: time, filters, visibility."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType, TimestampNTZType, TimestampType


def instant(t: str) -> Column:
    return F.lit(t).cast("timestamp")


def _open(c: str, t: Column) -> Column:
    return F.col(c).isNull() | (F.col(c) > t)


def _begun(t: Column) -> Column:
    return F.col("valid_at").isNull() | (F.col("valid_at") <= t)


def active_in_search(now: Column) -> Column:
    """Active, begun, and neither ended nor expired."""
    return (F.col("status") == "active") & _begun(now) & _open("invalid_at", now) & _open("expired_at", now)


def active_in_state(now: Column) -> Column:
    """Active, begun and not ended; the expiry does not matter."""
    return (F.col("status") == "active") & _begun(now) & _open("invalid_at", now)


def as_of(t: Column) -> Column:
    """True at ``t`` whatever the status."""
    return _begun(t) & _open("invalid_at", t) & _open("expired_at", t)


def still_valid(now: Column) -> Column:
    """Not ended, not expired, active; a future start passes."""
    return (F.col("status") == "active") & _open("invalid_at", now) & _open("expired_at", now)


def _compare(c: Column, op: str, value: Column) -> Column | None:
    return {"=": c == value, "!=": c != value, "<>": c != value, ">": c > value, ">=": c >= value, "<": c < value, "<=": c <= value}.get(op)


def date_dnf(column: str, groups: list[list[tuple[str, str | None]]] | None) -> Column:
    """OR of ANDs of (operator, time). No groups pass; a null fails except for the null tests; unknown operators pass."""
    if not groups:
        return F.lit(True)
    c = F.col(column)

    def clause(op: str, value: str | None) -> Column:
        if op.upper() == "IS NULL":
            return c.isNull()
        if op.upper() == "IS NOT NULL":
            return c.isNotNull()
        found = _compare(c, op, instant(value)) if value is not None else F.lit(False)
        return F.lit(True) if found is None else F.coalesce(found, F.lit(False))

    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [clause(*x) for x in g], F.lit(True)) for g in groups])


def property_filter(schema: StructType, name: str, op: str, value: object) -> Column:
    """Comparison with a column, numbers as numbers. No operator means equality; an unknown one passes; a column that
    is not there, and an ordered comparison of unlike kinds, fail."""
    if name not in schema.names:
        return F.lit(False)
    op = op or "="
    c, kind = F.col(name), schema[name].dataType
    if op not in ("=", "!=", "<>", ">", ">=", "<", "<="):
        return F.lit(True)
    if isinstance(kind, NumericType):
        try:
            return F.coalesce(_compare(c.cast("double"), op, F.lit(float(value))), F.lit(False))
        except (TypeError, ValueError):
            return F.lit(op in ("!=", "<>"))
    if isinstance(kind, TimestampType | TimestampNTZType):
        return F.coalesce(_compare(c.cast("timestamp"), op, instant(str(value))), F.lit(False))
    return F.coalesce(_compare(c.cast("string"), op, F.lit(str(value))), F.lit(False))


@dataclass(frozen=True)
class EdgeFilter:
    """None sets no limit, an empty list lets nothing pass."""

    types: list[str] | None = None
    uuids: list[str] | None = None
    dates: dict[str, list[list[tuple[str, str | None]]]] = field(default_factory=dict)
    properties: list[tuple[str, str, object]] = field(default_factory=list)
    classes: list[str] | None = None


def edge_passes(f: EdgeFilter, schema: StructType) -> Column:
    parts = [date_dnf(c, g) for c, g in f.dates.items()] + [property_filter(schema, *p) for p in f.properties]
    for names, col in ((f.types, F.col("pred")), (f.uuids, F.col("uuid"))):
        if names is not None:
            parts.append(col.isin(*names) if names else F.lit(False))
    if f.classes is not None:
        parts.append(class_is("memory_class", f.classes))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def class_is(column: str, classes: list[str]) -> Column:
    """Memory class, objective by default."""
    c = F.lower(F.trim(F.coalesce(F.col(column), F.lit(""))))
    return F.when(c == "", "objective").otherwise(c).isin(*[x.lower() for x in classes]) if classes else F.lit(False)


def node_passes(labels: list[str] | None) -> Column:
    """Any of the labels."""
    return F.lit(True) if labels is None else F.arrays_overlap(F.col("labels"), F.array(*map(F.lit, labels)).cast("array<string>"))


@dataclass(frozen=True)
class GraphRead:
    """Settings of a graph read. ``visibility``: all, active, conflicts, derived, non_derived or invalidated."""

    at: str | None = None
    include_invalid: bool = False
    status: str | None = None
    source_type: str | None = None
    relation: str | None = None
    visibility: str = "all"
    min_confidence: float | None = None
    after: str | None = None
    before: str | None = None


def graph_read(p: GraphRead) -> Column:
    out = F.lit(True)
    if p.at:
        out &= as_of(instant(p.at))
    elif not p.include_invalid and p.visibility != "invalidated":
        out &= F.col("invalid_at").isNull() & F.col("expired_at").isNull()
    for value, name in ((p.status, "status"), (p.source_type, "source_type")):
        if value:
            out &= F.col(name) == value
    if p.relation:
        out &= (F.col("canonical") == p.relation) | (F.col("pred") == p.relation)
    out &= {
        "all": F.lit(True), "active": F.col("status") == "active", "conflicts": F.col("status") == "needs_resolution", "derived": F.col("source_type") == "assistant",
        "non_derived": F.col("source_type") != "assistant", "invalidated": F.col("invalid_at").isNotNull() | F.col("expired_at").isNotNull(),
    }[p.visibility]
    if p.min_confidence is not None:
        out &= F.col("confidence").isNull() | (F.col("confidence") >= p.min_confidence)
    if p.after:
        out &= F.col("valid_at").isNull() | (F.col("valid_at") >= instant(p.after))
    if p.before:
        out &= F.col("valid_at").isNull() | (F.col("valid_at") <= instant(p.before))
    return out
