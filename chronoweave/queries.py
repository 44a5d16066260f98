"""Queries of the general data problems over the memory graph's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave import graph_queries
from chronoweave.operators import intervals, references, timestamps
from chronoweave.sources.tables import bare_key, load, trimmed


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps, and periods made of several intervals, of the facts of a subject and predicate."""
    facts = load(spark, sf_dir, "relates_to").select("source_node_uuid", F.lower(trimmed(F.col("name"))).alias("name"), "valid_at", "invalid_at")
    merged = intervals.periods_and_gaps(facts, "source_node_uuid", "name", "valid_at", "invalid_at")
    side = lambda c: F.coalesce(F.col(c), F.lit(-1).cast("long")).alias(c)
    return merged.where("kind = 'gap' or merged").select("kind", F.col("key1").alias("source_node_uuid"), F.col("key2").alias("name"), side("start_us"), side("end_us"))


_P3_SQL = r"""
with r as (
  select distinct source_node_uuid, lower(regexp_replace(name, '^\s+|\s+$', '', 'g')) as name,
    coalesce(epoch_us(valid_at), -9223372036854775807) as s, coalesce(epoch_us(invalid_at), 9223372036854775807) as e
  from relates_to where valid_at is null or invalid_at is null or invalid_at > valid_at),
m as (select *, max(e) over (partition by source_node_uuid, name order by s, e rows between unbounded preceding and 1 preceding) as reach from r),
b as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by source_node_uuid, name order by s, e) as no from m),
p as (select source_node_uuid, name, no, min(s) as s, max(e) as e, count(*) as n from b group by all),
g as (select source_node_uuid, name, e as s, lead(s) over (partition by source_node_uuid, name order by no) as e from p)
select 'gap' as kind, source_node_uuid, name, s as start_us, e as end_us from g where e is not null
union all
select 'period', source_node_uuid, name, case when s = -9223372036854775807 then -1 else s end, case when e = 9223372036854775807 then -1 else e end from p where n > 1
"""


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity, fact, episode = (load(spark, sf_dir, t) for t in ("entity", "relates_to", "episode"))
    refs = [
        references.children(entity, "entity", "merged_into", "uuid", bare_key(F.col("merged_into"), "entity"), "entity", "created_at", late=False),
        references.children(fact, "relates_to", "in_link", "uuid", bare_key(F.col("in_link"), "entity"), "entity", "created_at"),
        references.children(fact, "relates_to", "out_link", "uuid", bare_key(F.col("out_link"), "entity"), "entity", "created_at"),
        references.children(episode.withColumn("edge", F.explode("entity_edges")), "episode", "entity_edges", "uuid", bare_key(F.col("edge"), "relates_to"), "relates_to", "created_at"),
    ]
    return references.broken_references(refs, {"entity": (entity, "uuid", "created_at"), "relates_to": (fact, "uuid", "created_at")}, load(spark, sf_dir, "graph_deletion"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to entities and facts that are missing, deleted or late."""
    return _broken(spark, sf_dir).select("tbl", "field", "record_key", "ref_uuid", "reason", "ref_month")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken references per table, field, reason and month."""
    return references.broken_report(_broken(spark, sf_dir))


_P4_CTE = r"""
with bare as (
  select 'entity' as tbl, 'merged_into' as field, uuid as record_key, merged_into as raw, 'entity' as parent, created_at, false as late from entity
  union all select 'relates_to', 'in_link', uuid, in_link, 'entity', created_at, true from relates_to
  union all select 'relates_to', 'out_link', uuid, out_link, 'entity', created_at, true from relates_to
  union all select 'episode', 'entity_edges', uuid, unnest(entity_edges), 'relates_to', created_at, true from episode),
refs as (select *, trim(regexp_replace(regexp_replace(trim(raw), '^' || parent || ':', ''), '^⟨(.*)⟩$', '\1')) as key from bare where raw is not null),
parents as (select 'entity' as parent, uuid as key, min(created_at) as born from entity group by uuid
  union all select 'relates_to', uuid, min(created_at) from relates_to group by uuid),
gone as (select distinct tbl as parent, uuid as key from graph_deletion),
found as (
  select distinct r.tbl, r.field, r.record_key, r.key as ref_uuid,
    case when p.key is not null then 'late' when g.key is not null then 'deleted' else 'missing' end as reason,
    strftime(r.created_at, '%Y-%m') as ref_month
  from refs r left join parents p on p.parent = r.parent and p.key = r.key left join gone g on g.parent = r.parent and g.key = r.key
  where r.key <> '' and (p.key is null or (r.late and p.born > r.created_at)))
"""


def _time_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = timestamps.long_form(load(spark, sf_dir, "extracted_fact"), "extracted_fact", "fact_id", ["valid_at", "invalid_at"], "client_zone", "client_locale")
    episodes = timestamps.long_form(load(spark, sf_dir, "episode"), "episode", "uuid", ["reference_time"], "client_zone", "client_locale")
    return facts.unionByName(episodes)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTC instants of the timestamps that are not in the canonical notation yet; declared orders bind."""
    values = _time_values(spark, sf_dir).where(~F.col("value").rlike(timestamps.CANONICAL))
    return timestamps.normalise(values).where("utc_us is not null").select("tbl", "record_key", "field", "utc_us").distinct()


def p5_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every timestamp with its most likely reading, the next one, and what is wrong with those that have none."""
    read = timestamps.normalise(_time_values(spark, sf_dir), binding=False)
    return read.select("tbl", "record_key", "field", "value", "notation", F.round("posterior", 6).alias("posterior"), "ambiguous", "utc_us", "other_us", "problem").distinct()


QUERIES = graph_queries.QUERIES | {"p3_found": p3_found, "p4_found": p4_found, "p4_report": p4_report, "p5_found": p5_found, "p5_normalised": p5_normalised}
ORACLE = graph_queries.ORACLE | {
    "p3_found": _P3_SQL,
    "p4_found": _P4_CTE + "select * from found",
    "p4_report": _P4_CTE + "select tbl, field, reason, ref_month, count(*) as n_refs, count(distinct ref_uuid) as n_keys from found group by all",
}
