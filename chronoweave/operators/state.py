"""Temporal truth: what holds now, what held then, and how new assertions change it.

Slots of a subject and predicate are maintained in two ways. ``recompute`` is a window plan for logs without
explicit ends; ``replay`` follows the arrival order slot by slot and is exact for late and ended assertions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.predicates import active_in_state, as_of


def current_facts(facts: DataFrame, now: Column) -> DataFrame:
    return facts.where(active_in_state(now))


def current_profile(facts: DataFrame, now: Column) -> DataFrame:
    """Objects in force per subject and relation, in order."""
    return current_facts(facts, now).groupBy("group_id", "subj", "canonical").agg(F.count("*").alias("n_facts"), F.array_join(F.sort_array(F.collect_set("obj")), ",").alias("objects"))


def facts_as_of(facts: DataFrame, t: Column) -> DataFrame:
    return facts.where(as_of(t))


def state_as_of(facts: DataFrame, t: Column) -> DataFrame:
    """The latest fact in force per subject, relation and object."""
    at = Window.partitionBy("subj", "canonical", "obj").orderBy(F.col("valid_at").desc_nulls_last(), "uuid")
    return facts_as_of(facts, t).withColumn("_n", F.row_number().over(at)).where("_n = 1").drop("_n")


def recompute(log: DataFrame, slot: list[str], obj: str, at: str, order: str, now: Column) -> DataFrame:
    """Slowly changing slots from assertions without explicit ends, in the order of validity.

    A repeated object continues its interval; another object ends it. Of two assertions at one time the
    later in ``order`` wins and the earlier gets an empty interval. Rows without a time open the slot.
    """
    w = Window.partitionBy(*slot).orderBy(F.col(at).asc_nulls_first(), F.col(order))
    runs = log.withColumn("_before", F.lag(obj).over(w)).withColumn("_first", F.row_number().over(w) == 1).where(F.col("_first") | ~F.col("_before").eqNullSafe(F.col(obj)))
    out = runs.withColumn("ends_at", F.lead(at).over(w)).withColumn("superseded_by", F.lead(order).over(w)).withColumn("supersedes", F.lag(order).over(w))
    return out.withColumn("state", F.when(F.col("ends_at") <= now, "superseded").otherwise("active")).drop("_before", "_first")


_REPLAYED = "slot string, ord long, obj string, start_us long, end_us long, closed_by long, n_merged int"


def replay_slot(rows: list[tuple[int, str, int, int | None]]) -> list[list]:
    """Assertions (ord, object, start, end) in arrival order; returns [ord, object, start, end, closed by, merged].

    An assertion of the object in force at its start is merged. A new one ends at the next start in the slot,
    and ends the intervals of other objects that contain its start.
    """
    held: list[list] = []
    for ord_, obj, start, end in rows:
        same = next((h for h in held if h[1] == obj and h[2] <= start and (h[3] is None or h[3] > start)), None)
        if same:
            same[5] += 1
            continue
        later = min((h[2] for h in held if h[2] > start), default=None)
        if later is not None and (end is None or later < end):
            end = later
        for h in held:
            if h[1] != obj and h[2] <= start and (h[3] is None or h[3] > start):
                h[3], h[4] = start, ord_
        held.append([ord_, obj, start, end, None, 0])
    return held


def replay(log: DataFrame) -> DataFrame:
    """Slots replayed in arrival order; ``log`` has ``slot, ord, obj, start_us, end_us``.

    A slot is one subject and predicate and is kept by one task, as each assertion depends on those before.
    Rows without a slot, order or start are left out.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        rows = [(o, x, s, None if pd.isna(e) else int(e)) for o, x, s, e in zip(pdf["ord"], pdf["obj"], pdf["start_us"], pdf["end_us"])]
        out = pd.DataFrame(replay_slot(rows), columns=["ord", "obj", "start_us", "end_us", "closed_by", "n_merged"])
        out.insert(0, "slot", pdf["slot"].iloc[0])
        return out.astype({"end_us": "Int64", "closed_by": "Int64"})

    return log.select("slot", "ord", "obj", "start_us", "end_us").where("slot is not null and ord is not null and start_us is not null").groupBy("slot").applyInPandas(run, _REPLAYED)


def invalidate(facts: DataFrame, ends: DataFrame, now: Column) -> DataFrame:
    """Facts with their end moved to ``ends`` (``uuid, end_at, by``) where that is earlier; a future end stays active."""
    j = facts.join(ends.select("uuid", F.col("end_at").alias("_end"), F.col("by").alias("superseded_by")), "uuid", "left")
    applies = F.col("_end").isNotNull() & (F.col("invalid_at").isNull() | (F.col("invalid_at") > F.col("_end")))
    done = applies & (F.col("_end") <= now)
    return j.select(
        *[c for c in facts.columns if c not in ("invalid_at", "expired_at", "status")],
        F.when(applies, F.col("_end")).otherwise(F.col("invalid_at")).alias("invalid_at"), F.when(done, now).otherwise(F.col("expired_at")).alias("expired_at"),
        F.when(done, "superseded").otherwise(F.col("status")).alias("status"), F.when(applies, F.col("superseded_by")).alias("superseded_by"),
    )


def conflict_peers(facts: DataFrame, now: Column) -> DataFrame:
    """Slots of one-valued relations in which several objects are in force."""
    live = current_facts(facts.where("singleton"), now)
    return live.groupBy("group_id", "subj", "canonical").agg(F.count_distinct("obj").alias("n_objects"), F.min("uuid").alias("first_uuid"), F.count("*").alias("n_facts")).where("n_objects > 1")


def collisions(facts: DataFrame) -> DataFrame:
    """Fact keys with more than one open row; ``facts`` has ``fact_key``."""
    return facts.where("invalid_at is null").groupBy("group_id", "fact_key").agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def collision_ranks(facts: DataFrame) -> DataFrame:
    """Open rows of colliding keys; the winner has ``place`` 1: active, open, oldest, smallest uuid."""
    at = Window.partitionBy("group_id", "fact_key")
    order = at.orderBy((F.col("status") != "active").cast("int"), (F.col("invalid_at").isNotNull() | F.col("expired_at").isNotNull()).cast("int"), F.col("created_at").asc_nulls_first(), "uuid")
    return facts.where("invalid_at is null").withColumn("n_rows", F.count("*").over(at)).where("n_rows > 1").withColumn("place", F.row_number().over(order))


def collision_merge(facts: DataFrame) -> DataFrame:
    """The winner with the episodes of all, and the losers under a legacy key."""
    ranked = collision_ranks(facts)
    merged = ranked.groupBy("group_id", "fact_key").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("episodes")))), ",").alias("all_episodes"))
    lost = F.col("place") > 1
    return ranked.join(merged, ["group_id", "fact_key"]).select(
        "uuid", F.when(lost, F.concat_ws("::", "fact_key", F.lit("legacy-duplicate"), "uuid")).otherwise(F.col("fact_key")).alias("fact_key"),
        F.when(lost, "superseded").otherwise(F.col("status")).alias("status"), F.when(lost, "").otherwise(F.col("all_episodes")).alias("episodes"),
    )


def remove_episodes(facts: DataFrame, gone: DataFrame) -> DataFrame:
    """Facts after the episodes ``gone`` (``episode``) went: facts of no other source go too, others lose the link."""
    links = facts.select("uuid", F.explode("episodes").alias("episode"))
    kept = links.join(gone, "episode", "left_anti").groupBy("uuid").agg(F.array_sort(F.collect_set("episode")).alias("left_over"))
    touched = links.join(gone, "episode", "left_semi").select("uuid").distinct().withColumn("touched", F.lit(True))
    j = facts.join(touched, "uuid", "left").join(kept, "uuid", "left")
    return j.where("touched is null or left_over is not null").select("uuid", F.coalesce("touched", F.lit(False)).alias("touched"), F.size(F.coalesce("left_over", F.array().cast("array<string>"))).alias("n_episodes"))


def upsert(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` over those of ``base``, null columns keeping the old value; ``key`` is unique in both."""
    old = base.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in base.columns if c != key])
    joined = new.join(old, key, "full_outer")
    return joined.select(key, *[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in new.columns else F.col(f"_{c}").alias(c) for c in base.columns if c != key])


def first_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in an order, for lists that were united."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


