"""References to records that do not exist, were deleted, or arrived later than the row naming them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def children(df: DataFrame, table: str, field: str, record: str, keys: Column, parent: str, at: str, late: bool = True) -> DataFrame:
    """Long form of one reference field: a row per record and key it names. ``late``: whether order matters."""
    return df.select(
        F.lit(table).alias("tbl"), F.lit(field).alias("field"), F.col(record).alias("record_key"), keys.alias("key"),
        F.lit(parent).alias("parent"), F.col(at).alias("at"), F.lit(late).alias("late"),
    ).where("key is not null")


def broken_references(refs: list[DataFrame], parents: dict[str, tuple[DataFrame, str, str]], deletions: DataFrame) -> DataFrame:
    """Every reference whose target is not there, with the reason ``deleted``, ``missing`` or ``late``.

    ``refs`` come from :func:`children`; ``parents`` maps a table to (rows, key column, creation time);
    ``deletions`` has ``tbl`` and ``uuid``. Parent, child and deletion keys are united in long form and
    grouped by (parent table, key). The group keeps flags and extreme times only, so map-side aggregation
    shrinks a key that a third of all rows name to one row per task. Groups without the parent flag, or
    whose parent is younger than a child, are the only keys joined back to the references.

    Null keys are no reference. A parent key that was deleted and written again exists. Of several rows of
    one parent the oldest counts; a target or a naming row without a time is never late. Repeated rows
    give one result row. Empty tables are allowed on any side.
    """
    refs_all = reduce(DataFrame.unionByName, refs)
    no_ts = F.lit(None).cast("timestamp")
    tagged = [refs_all.select("parent", "key", F.lit(False).alias("is_parent"), F.lit(False).alias("is_deleted"), F.lit(True).alias("is_child"), no_ts.alias("born"), F.when(F.col("late"), F.col("at").cast("timestamp")).alias("named"))]
    for table, (df, key, at) in parents.items():
        tagged.append(df.select(F.lit(table).alias("parent"), F.col(key).alias("key"), F.lit(True).alias("is_parent"), F.lit(False).alias("is_deleted"), F.lit(False).alias("is_child"), F.col(at).cast("timestamp").alias("born"), no_ts.alias("named")))
    tagged.append(deletions.select(F.col("tbl").alias("parent"), F.col("uuid").alias("key"), F.lit(False).alias("is_parent"), F.lit(True).alias("is_deleted"), F.lit(False).alias("is_child"), no_ts.alias("born"), no_ts.alias("named")))
    groups = reduce(DataFrame.unionByName, tagged).where("key is not null").groupBy("parent", "key").agg(
        F.max("is_parent").alias("is_parent"), F.max("is_deleted").alias("is_deleted"), F.max("is_child").alias("is_child"),
        F.min("born").alias("born"), F.min("named").alias("named"),
    )
    broken = groups.where("is_child and (not is_parent or born > named)").select("parent", "key", "is_parent", "is_deleted", "born")
    found = refs_all.join(broken, ["parent", "key"]).where("not is_parent or (late and born > cast(at as timestamp))")
    return found.select(
        "tbl", "field", "record_key", F.col("key").alias("ref_uuid"), "parent",
        F.when(F.col("is_parent"), "late").when(F.col("is_deleted"), "deleted").otherwise("missing").alias("reason"),
        F.date_format(F.col("at").cast("timestamp"), "yyyy-MM").alias("ref_month"),
    ).distinct()


def broken_report(found: DataFrame) -> DataFrame:
    """Counts of broken references per table, field, reason and month."""
    return found.groupBy("tbl", "field", "reason", "ref_month").agg(F.count("*").alias("n_refs"), F.count_distinct("ref_uuid").alias("n_keys"))
