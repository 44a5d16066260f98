"""Read models around the graph: resources, self patterns, cognition views, predictions and contradictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.predicates import active_in_state


def resources(episodes: DataFrame) -> DataFrame:
    """A card per group and external source that episodes came from, with its first and last use."""
    named = episodes.where("source_description is not null and trim(source_description) != ''")
    return named.groupBy("group_id", F.trim("source_description").alias("resource")).agg(F.count("*").alias("n_episodes"), F.min("uuid").alias("first_uuid"))


def resource_support(episodes: DataFrame, facts: DataFrame) -> DataFrame:
    """Distinct facts and endpoints that rest on a resource's episodes."""
    ep = episodes.where("source_description is not null and trim(source_description) != ''").select("group_id", F.trim("source_description").alias("resource"), F.col("uuid").alias("episode"))
    rows = facts.select(F.col("uuid").alias("fact"), F.explode("episodes").alias("episode"), F.array("subj", "obj").alias("ends"))
    j = ep.join(rows, "episode").select("group_id", "resource", "fact", F.explode("ends").alias("node")).where("node is not null").distinct()
    return j.groupBy("group_id", "resource").agg(F.count_distinct("fact").alias("n_facts"), F.count_distinct("node").alias("n_nodes"))


def self_patterns(episodes: DataFrame) -> DataFrame:
    """Share of each kind of self episode among a group's episodes."""
    all_ = episodes.groupBy("group_id").agg(F.count("*").alias("n_all"))
    own = episodes.where(F.col("source").contains("self_")).groupBy("group_id", "source").agg(F.count("*").alias("n"))
    return own.join(all_, "group_id").select("group_id", "source", "n", F.round(F.col("n") / F.col("n_all"), 6).alias("frequency"))


def most_mentioned(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """The entity a group's episodes mention most: its speaker, if nothing better is known."""
    counts = mentions.join(entities.select(F.col("uuid").alias("entity"), "group_id"), "entity").groupBy("group_id", "entity").agg(F.count("*").alias("n"))
    return counts.withColumn("_n", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("n"), "entity"))).where("_n = 1").drop("_n")


def cognition_summary(facts: DataFrame, episodes: DataFrame, entities: DataFrame) -> DataFrame:
    """The counts of a group's cognition: beliefs, traits, goals, affect, consolidated and reinforced facts, procedures."""
    f = facts.groupBy("group_id").agg(F.count_if("is_belief").alias("beliefs"), F.count_if(F.col("memory_class") == "consolidated").alias("consolidated_edges"), F.count_if(F.col("reinforcement_count") > 0).alias("reinforced_edges"))
    e = episodes.groupBy("group_id").agg(F.count_if(F.col("affect").isNotNull() & ~F.trim("affect").isin("", "{}")).alias("affect_tagged_episodes"), F.count("interaction_pattern").alias("procedural_episodes"))
    n = entities.groupBy("group_id").agg(F.count_if(F.array_contains("labels", "trait")).alias("trait_nodes"), F.count_if(F.array_contains("labels", "goal")).alias("goal_nodes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    kinds = ("beliefs", "trait_nodes", "goal_nodes", "affect_tagged_episodes", "consolidated_edges", "reinforced_edges", "procedural_episodes")
    return f.join(e, "group_id", "full_outer").join(n, "group_id", "full_outer").select("group_id", *map(zero, kinds))


def top_relations(facts: DataFrame, now: Column, most: int = 5) -> DataFrame:
    """The relations that rule a group now: the domains of its prediction bundle."""
    counts = facts.where(active_in_state(now)).groupBy("group_id", "canonical").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("n"), "canonical"))).where(F.col("place") <= most)


def prediction_bundle(entities: DataFrame, episodes: DataFrame) -> DataFrame:
    """What a group's prediction is made of: goals (at most 10), the five most frequent domains, and the mode of the last 8 patterns.

    Goals are entities labelled ``goal``, domains those of entities; ties go to the smaller domain, and to the pattern seen last.
    Groups with none of the three have no row.
    """
    first = lambda df, order, most: df.withColumn("_n", F.row_number().over(Window.partitionBy("group_id").orderBy(*order))).where(F.col("_n") <= most)
    goals = first(entities.where(F.array_contains("labels", "goal")), ["uuid"], 10).groupBy("group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "name"))), lambda x: x["name"]), ",").alias("goals"))
    counts = entities.where("domain != ''").groupBy("group_id", "domain").agg(F.count("*").alias("n"))
    tops = first(counts, [F.desc("n"), "domain"], 5).groupBy("group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "domain"))), lambda x: x["domain"]), ",").alias("domains"))
    last = first(episodes.where("interaction_pattern is not null"), [F.desc("created_at"), F.desc("uuid")], 8).where("interaction_pattern != ''").groupBy("group_id", "interaction_pattern").agg(F.count("*").alias("hits"), F.min("_n").alias("latest"))
    mode = first(last, [F.desc("hits"), "latest"], 1).select("group_id", F.col("interaction_pattern").alias("pattern"))
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return tops.join(goals, "group_id", "full_outer").join(mode, "group_id", "full_outer").select("group_id", empty("domains"), empty("goals"), empty("pattern"))


def upsert_resources(known: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Library items after ``incoming`` ones: one row per ``group_id`` and ``library_item_id``, which keeps its first uuid and creation.

    Both have ``uuid, group_id, library_item_id, title, kind, relationship, summary, available, created_at, updated_at``. Rows without
    a group or item are left out; of repeated incoming items the last by ``updated_at``, then uuid, stands.
    """
    keys = ["group_id", "library_item_id"]
    keyed = lambda df: df.where("group_id is not null and library_item_id is not null")
    new = keyed(incoming).groupBy(*keys).agg(F.max_by(F.struct(*[c for c in known.columns if c not in keys]), F.struct("updated_at", "uuid")).alias("new"))
    old = keyed(known).groupBy(*keys).agg(F.min_by(F.struct(*[c for c in known.columns if c not in keys]), F.struct("created_at", "uuid")).alias("old"))
    j = old.join(new, keys, "full_outer")
    pick = lambda c: F.coalesce(F.col(f"old.{c}"), F.col(f"new.{c}")) if c in ("uuid", "created_at") else F.when(F.col("new").isNotNull(), now if c == "updated_at" else F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
    return j.select(*[F.col(c) if c in keys else pick(c).alias(c) for c in known.columns])


def set_availability(resources: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Library items with ``available`` set by ``changes`` (``group_id, library_item_id, available``, one row an item)."""
    j = resources.join(changes.select("group_id", "library_item_id", F.col("available").alias("_set")), ["group_id", "library_item_id"], "left")
    return j.withColumn("available", F.coalesce("_set", "available")).withColumn("updated_at", F.when(F.col("_set").isNotNull(), now).otherwise(F.col("updated_at"))).select(*resources.columns)


def list_resources(resources: DataFrame, group: str, most: int = 100) -> DataFrame:
    """A page of a group's available items, with the usual kind and relationship where these are blank."""
    usual = lambda c, v: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.col(c)).otherwise(v).alias(c)
    page = resources.where((F.col("group_id") == group) & F.col("available")).orderBy("uuid").limit(most)
    return page.select(*[usual("kind", "document") if c == "kind" else usual("relationship", "reference_material") if c == "relationship" else F.col(c) for c in resources.columns])


def resource_owner(entities: DataFrame) -> DataFrame:
    """The entity that owns the library of each personal group (``user:<id>``): named like the user or the group, else labelled ``User``."""
    mine = entities.where(F.col("group_id").startswith("user:"))
    user = F.expr("substring(group_id, 6)")
    rank = F.when((F.col("name") == user) | (F.col("name") == F.col("group_id")), 0).when(F.array_contains("labels", "User"), 1)
    return mine.withColumn("_rank", rank).where("_rank is not null").groupBy("group_id").agg(F.min_by("uuid", F.struct("_rank", "uuid")).alias("owner"))


def resource_links(resources: DataFrame, episodes: DataFrame, facts: DataFrame, owners: DataFrame) -> DataFrame:
    """Links of library items: to their owner, to episodes that consulted them (``source:<item>``) and to the endpoints of these episodes' facts.

    ``group_id, resource, relation, target``; owners are no target of a fact. Every link is one row.
    """
    item = resources.select("group_id", F.col("uuid").alias("resource"), "library_item_id")
    own = item.join(owners, "group_id").select("group_id", "resource", F.lit("owner").alias("relation"), F.col("owner").alias("target"))
    used = item.withColumn("source_description", F.concat(F.lit("source:"), F.col("library_item_id"))).join(episodes.select("group_id", F.col("uuid").alias("episode"), "source_description"), ["group_id", "source_description"])
    told = facts.select(F.explode(F.array_distinct("episodes")).alias("episode"), F.array("subj", "obj").alias("ends")).select("episode", F.explode("ends").alias("target"))
    ends = used.join(told, "episode").where("target is not null").join(owners, "group_id", "left").where("owner is null or target != owner")
    return own.unionByName(used.select("group_id", "resource", F.lit("consulted_in").alias("relation"), F.col("episode").alias("target"))).unionByName(ends.select("group_id", "resource", F.lit("supports").alias("relation"), "target")).distinct()


def contradictions(facts: DataFrame) -> DataFrame:
    """Pairs of one-valued facts of a subject and relation with unlike objects that hold at the same time.

    The join is by subject and relation; the pairs of a slot are the result itself.
    """
    one = facts.where("singleton and status != 'superseded' and subj is not null and valid_at is not null").select("uuid", "group_id", "subj", "canonical", "obj", "valid_at", "invalid_at")
    other = one.select(F.col("uuid").alias("uuid_b"), "group_id", "subj", "canonical", F.col("obj").alias("obj_b"), F.col("valid_at").alias("from_b"), F.col("invalid_at").alias("to_b"))
    j = one.join(other, ["group_id", "subj", "canonical"]).where("uuid < uuid_b and obj != obj_b")
    return j.where("(to_b is null or valid_at < to_b) and (invalid_at is null or from_b < invalid_at)").select("uuid", "uuid_b")


def by_episode(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts and existing nodes of each episode."""
    rows = facts.select(F.explode(F.array_distinct("episodes")).alias("episode"), F.col("uuid").alias("fact"), F.array("subj", "obj").alias("ends"))
    f = rows.groupBy("episode").agg(F.count_distinct("fact").alias("n_facts"))
    n = rows.select("episode", F.explode("ends").alias("uuid")).join(entities.select("uuid"), "uuid", "left_semi").groupBy("episode").agg(F.count_distinct("uuid").alias("n_nodes"))
    return f.join(n, "episode", "left").select("episode", "n_facts", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"))


def message_body(content: Column) -> Column:
    """The body of a message written as a JSON object, fenced or not; other content as it is."""
    bare = F.regexp_replace(F.trim(content), r"^```(?:json)?\s*|\s*```$", "")
    return F.coalesce(F.when(bare.startswith("{"), F.get_json_object(bare, "$.body")), content)
