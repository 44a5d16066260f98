"""Readers for the tables of the memory graph and small text helpers for its keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as blank around keys and labels.
BLANK = r"^\s+|\s+$"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder. Zone-less timestamps mean UTC, so the session is set to UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, BLANK, "")


def bare_key(c: Column, table: str) -> Column:
    """Key of a record link: ``x``, ``table:x`` and ``table:⟨x⟩`` all give ``x``; blank gives null."""
    inner = F.regexp_replace(trimmed(c), rf"^{table}:", "")
    inner = trimmed(F.regexp_replace(inner, r"^⟨(.*)⟩$", "$1"))
    return F.when(inner != "", inner)


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a zone-less or zoned timestamp (session zone UTC)."""
    return F.unix_micros(c.cast("timestamp"))
