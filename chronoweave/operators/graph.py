"""Graph views: links, mentions, degree, neighbourhoods, communities, profiles, explanations and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.text import profile_summary
from chronoweave.operators.predicates import GraphRead, active_in_state, graph_read
from chronoweave.plans.scratch import Scratch

#: Tables and default visibility of the named views of a graph.
VIEWS = {
    "truth": (("entities", "relates_to"), "active"),
    "raw": (("episodes", "entities", "relates_to"), "all"),
    "provenance": (("episodes", "entities", "relates_to", "mentions"), "all"),
    "conflicts": (("entities", "relates_to"), "conflicts"),
    "timeline": (("episodes", "relates_to"), "all"),
    "frames": (("frames", "relates_to"), "all"),
    "self": (("entities",), "all"),
    "vitality": (("entities",), "all"),
}
ROWS = (50, 1500, 10_000)  # least, default and most rows of a graph read


def clamp_rows(wanted: int | None, bounds: tuple[int, int, int] = ROWS) -> int:
    return bounds[1] if not wanted or wanted < 0 else min(max(wanted, bounds[0]), bounds[2])


def links(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts both of whose endpoints exist."""
    ids = entities.select("uuid")
    return facts.join(ids.withColumnRenamed("uuid", "subj"), "subj", "left_semi").join(ids.withColumnRenamed("uuid", "obj"), "obj", "left_semi")


def mentions(facts: DataFrame) -> DataFrame:
    """``episode, entity, fact``: an episode mentions the endpoints of the facts it is a source of."""
    rows = facts.select(F.col("uuid").alias("fact"), F.explode("episodes").alias("episode"), F.array("subj", "obj").alias("ends"))
    return rows.select("episode", "fact", F.explode("ends").alias("entity")).where("entity is not null")


def mention_aggregate(rows: DataFrame) -> DataFrame:
    return rows.groupBy("episode", "entity").agg(F.count("*").alias("n_mentions"), F.min("fact").alias("first_fact"))


def degree(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("subj").alias("node")).unionByName(edges.select(F.col("obj").alias("node")))
    return ends.where("node is not null").groupBy("node").agg(F.count("*").alias("degree"))


def ego(edges: DataFrame, focal: str, hops: int = 2) -> DataFrame:
    """``node, hop`` of the nodes within one or two hops of a node, itself at hop 0."""
    both = edges.select(F.col("subj").alias("a"), F.col("obj").alias("b")).unionByName(edges.select(F.col("obj").alias("a"), F.col("subj").alias("b"))).where("a is not null and b is not null").distinct()
    ring = edges.sparkSession.createDataFrame([(focal,)], "node string")
    out = ring.withColumn("hop", F.lit(0))
    for hop in range(1, min(max(hops, 1), 2) + 1):
        ring = both.join(ring, both["a"] == ring["node"]).select(F.col("b").alias("node")).distinct()
        out = out.unionByName(ring.withColumn("hop", F.lit(hop)))
    return out.groupBy("node").agg(F.min("hop").alias("hop"))


def communities(edges: DataFrame) -> DataFrame:
    """``group_id, node, community``: connected parts of the open edges of each group, of two nodes or more.

    Each round takes the smallest label around a node and then the label of that label; rounds are written
    to the shared folder until no label changes.
    """
    scratch = Scratch(edges.sparkSession, "communities")
    open_ = edges.where("invalid_at is null and subj is not null and obj is not null and subj != obj")
    both = scratch.save(open_.select("group_id", F.col("subj").alias("node"), F.col("obj").alias("other")).unionByName(open_.select("group_id", F.col("obj").alias("node"), F.col("subj").alias("other"))).distinct())
    labels = scratch.save(both.groupBy("group_id", "node").agg(F.least(F.min("other"), F.first("node")).alias("label")))
    while True:
        around = both.join(labels.select("group_id", F.col("node").alias("other"), F.col("label").alias("theirs")), ["group_id", "other"]).groupBy("group_id", "node").agg(F.min("theirs").alias("theirs"))
        nearer = labels.join(around, ["group_id", "node"]).select("group_id", "node", "label", F.least("label", "theirs").alias("near"))
        jump = labels.select("group_id", F.col("node").alias("near"), F.col("label").alias("far"))
        new = scratch.save(nearer.join(jump, ["group_id", "near"], "left").select("group_id", "node", F.least("near", "far").alias("label"), (F.least("near", "far") < F.col("label")).alias("moved")))
        scratch.drop(labels)
        labels = new
        if labels.where("moved").isEmpty():
            return labels.select("group_id", "node", F.col("label").alias("community"))


def community_report(members: DataFrame, edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Size and head of each community: the member of greatest degree, then the smallest uuid."""
    deg = degree(edges.where("invalid_at is null and subj != obj"))
    named = members.join(deg, "node", "left").join(entities.select(F.col("uuid").alias("node"), "name"), "node", "left")
    at = Window.partitionBy("group_id", "community").orderBy(F.desc("degree"), "node")
    ranked = named.withColumn("_n", F.row_number().over(at)).withColumn("n_members", F.count("*").over(Window.partitionBy("group_id", "community")))
    return ranked.where("_n = 1").select("group_id", "community", "n_members", F.col("node").alias("head"), F.coalesce("name", F.lit("")).alias("head_name"))


def entity_profiles(facts: DataFrame, entities: DataFrame, now: Column, most: int = 30) -> DataFrame:
    """``uuid, n_facts, summary``: the newest open facts that touch an entity, put into one line."""
    live = facts.where(active_in_state(now))
    touch = live.select(F.col("subj").alias("uuid"), "fact", F.col("uuid").alias("fact_uuid"), F.coalesce("valid_at", "created_at").alias("at")).unionByName(live.where("subj != obj").select(F.col("obj").alias("uuid"), "fact", F.col("uuid").alias("fact_uuid"), F.coalesce("valid_at", "created_at").alias("at")))
    newest = touch.withColumn("_n", F.row_number().over(Window.partitionBy("uuid").orderBy(F.desc("at"), "fact_uuid"))).where(F.col("_n") <= most)
    lines = newest.groupBy("uuid").agg(F.count("*").alias("n_facts"), F.transform(F.array_sort(F.collect_list(F.struct("_n", "fact"))), lambda x: x["fact"]).alias("lines"))
    return entities.select("uuid", "name").join(lines, "uuid").select("uuid", "n_facts", profile_summary(F.col("name"), F.col("lines")).alias("summary"))


def explain(facts: DataFrame, entities: DataFrame, frames: DataFrame) -> DataFrame:
    """Each fact with the names of its endpoints and the kind of its frame."""
    end = lambda c: entities.select(F.col("uuid").alias(c), F.col("name").alias(f"{c}_name"))
    # The frame table is settings: a few rows per relation, so its side is checked by the planner's size limit.
    frame = frames.where("coalesce(group_id, '') = ''").groupBy(F.col("canonical_name").alias("canonical")).agg(F.min("temporal_kind").alias("temporal_kind"), F.min("cardinality").alias("cardinality"))
    return facts.join(end("subj"), "subj", "left").join(end("obj"), "obj", "left").join(frame, "canonical", "left").select("uuid", "subj_name", "obj_name", "canonical", "temporal_kind", "cardinality")


def sources(facts: DataFrame, episodes: DataFrame, most: int = 20, preview: int = 500) -> DataFrame:
    """The newest source episodes of each fact with a preview of their content."""
    j = facts.select("uuid", F.explode(F.array_distinct("episodes")).alias("episode")).join(episodes.select(F.col("uuid").alias("episode"), "created_at", "content"), "episode")
    at = Window.partitionBy("uuid").orderBy(F.desc("created_at"), "episode")
    return j.withColumn("place", F.row_number().over(at)).where(F.col("place") <= most).select("uuid", "episode", "place", F.left(F.col("content"), F.lit(preview)).alias("preview"))


def read_graph(facts: DataFrame, entities: DataFrame, view: str, settings: GraphRead | None = None, rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a view. The edges are the first ``rows`` by time, which is the feature's page size."""
    tables, visibility = VIEWS[view]
    if "relates_to" not in tables:
        return entities.orderBy("created_at", "uuid").limit(clamp_rows(rows)), facts.limit(0)
    p = settings or GraphRead(visibility=visibility)
    edges = links(facts.where(graph_read(p)), entities).orderBy("created_at", "uuid").limit(clamp_rows(rows))
    ends = edges.select(F.explode(F.array("subj", "obj")).alias("uuid")).distinct()
    return entities.join(ends, "uuid", "left_semi"), edges


def orphan_entities(entities: DataFrame, facts: DataFrame) -> DataFrame:
    ends = facts.select(F.explode(F.array("subj", "obj")).alias("uuid"))
    return entities.join(ends, "uuid", "left_anti").select("uuid", "group_id")


def orphan_episodes(episodes: DataFrame, facts: DataFrame) -> DataFrame:
    return episodes.join(facts.select(F.explode("episodes").alias("uuid")), "uuid", "left_anti").select("uuid", "group_id")


def duplicate_candidates(entities: DataFrame) -> DataFrame:
    named = entities.where("canonical_name is not null and canonical_name != ''")
    return named.groupBy("group_id", "canonical_name").agg(F.count("*").alias("n_entities"), F.min("uuid").alias("first_uuid")).where("n_entities > 1")


def inspect_counts(facts: DataFrame) -> DataFrame:
    """Facts per status, source type and memory class, in one pass."""
    long = facts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.coalesce(c, F.lit("unknown")).alias("value")) for c in ("status", "source_type", "memory_class")])).alias("p"))
    return long.groupBy("p.kind", "p.value").agg(F.count("*").alias("n_facts"))


def inspection(facts: DataFrame, entities: DataFrame, episodes: DataFrame, frames: DataFrame, low: float = 0.5) -> DataFrame:
    """The counts of a graph's report per group, one row a check; groups without a case of a check have no row of it.

    ``frames`` without a group count under the empty group.
    """
    check = lambda df, name, where="true": df.where(where).groupBy(F.coalesce("group_id", F.lit("")).alias("group_id")).agg(F.count("*").alias("n")).select("group_id", F.lit(name).alias("check"), "n")
    of_facts = facts.groupBy(F.coalesce("group_id", F.lit("")).alias("group_id")).agg(
        F.count_if(F.size("episodes") == 0).alias("facts_without_source_episodes"), F.count_if(F.col("confidence") < low).alias("low_confidence_facts"),
        F.count_if(F.expr("invalid_at is null and expired_at is null and status = 'active' and valid_at is not null")).alias("open_active_facts"), F.count("*").alias("total_relates_to"),
    )
    names = [c for c in of_facts.columns if c != "group_id"]
    long = of_facts.select("group_id", F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("n")) for c in names])).alias("p")).select("group_id", "p.check", "p.n").where("n > 0")
    rest = [check(episodes, "cognition_backlog_unprocessed", "cognition_processed_at is null"), check(entities, "total_entity"), check(episodes, "total_episode"), check(frames, "total_relation_frame")]
    for r in rest:
        long = long.unionByName(r)
    return long
