"""Who may see which fact: references of participants, grants and forgetting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.identity import memory_ref_key

ROLES = ("asserted", "witnessed", "granted", "endorsed", "disputed")


def write_refs(facts: DataFrame, speaker: Column, others: Column) -> DataFrame:
    """One reference per fact and participant: the speaker asserted it, the others witnessed it."""
    rows = facts.select("group_id", F.col("uuid").alias("fact_uuid"), speaker.alias("speaker"), F.explode(F.array_distinct(F.concat(F.array(speaker), others))).alias("actor"), "created_at").where("actor is not null")
    role = F.when(F.col("actor") == F.col("speaker"), "asserted").otherwise("witnessed")
    refs = rows.select("group_id", "actor", "fact_uuid", role.alias("role"), F.col("created_at").alias("valid_at"), F.lit(None).cast("timestamp").alias("invalid_at"))
    return refs.withColumn("key", memory_ref_key(F.col("group_id"), F.col("actor"), F.col("fact_uuid"), F.col("role"), F.lit(""))).dropDuplicates(["key"])


def visible(facts: DataFrame, refs: DataFrame, actor: str | None = None) -> DataFrame:
    """Facts a participant has an open reference to; of all participants if none is named."""
    live = refs.where("invalid_at is null")
    if actor is not None:
        live = live.where(F.col("actor") == actor)
    roles = live.groupBy("actor", "fact_uuid").agg(F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"))
    return roles.join(facts.withColumnRenamed("uuid", "fact_uuid"), "fact_uuid")


def grant(refs: DataFrame, wanted: DataFrame, at: Column) -> DataFrame:
    """References that ``wanted`` (``giver, receiver, fact_uuid``) adds; a giver must hold an open asserted reference."""
    held = refs.where("role = 'asserted' and invalid_at is null").select("group_id", F.col("actor").alias("giver"), "fact_uuid")
    new = wanted.join(held, ["giver", "fact_uuid"]).select("group_id", F.col("receiver").alias("actor"), "fact_uuid", F.lit("granted").alias("role"), at.alias("valid_at"), F.lit(None).cast("timestamp").alias("invalid_at"))
    keyed = new.withColumn("key", memory_ref_key(F.col("group_id"), F.col("actor"), F.col("fact_uuid"), F.col("role"), F.lit(""))).dropDuplicates(["key"])
    return keyed.join(refs.where("invalid_at is null").select("key"), "key", "left_anti")


def close(refs: DataFrame, which: Column, at: Column) -> DataFrame:
    """References with those of ``which`` closed; the facts stay. Forgetting and revoking are both this."""
    return refs.withColumn("invalid_at", F.when(which & F.col("invalid_at").isNull(), at).otherwise(F.col("invalid_at")))
