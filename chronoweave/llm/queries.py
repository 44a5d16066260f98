"""Queries of the training-data problems over the memory graph's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import components, mixing, names, neighbours, packing, pii, residue
from chronoweave.sources.tables import bare_key, load


_VECTORS = (("entity", "name_embedding"), ("relates_to", "fact_embedding"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records with a cosine of at least 0.90 of which one is among the other's 5 most similar."""
    parts = []
    for table, vector in _VECTORS:
        near = neighbours.nearest(load(spark, sf_dir, table), "uuid", vector, k=5, floor=0.90, conf=neighbours.MultiIndex(recall=0.999))
        parts.append(near.select(F.lit(table).alias("tbl"), F.least("query", "neighbour").alias("uuid_a"), F.greatest("query", "neighbour").alias("uuid_b")))
    return reduce(DataFrame.unionByName, parts).distinct()


_P1_SQL = """
with usable as (
  select distinct 'entity' as tbl, uuid, name_embedding::double[] as v from entity where len(name_embedding) = 64
  union select distinct 'relates_to', uuid, fact_embedding::double[] from relates_to where len(fact_embedding) = 64),
v as (select tbl, uuid, any_value(v)::double[64] as v from usable where len(list_filter(v, lambda x: isfinite(x))) = 64 and len(list_filter(v, lambda x: x <> 0)) > 0 group by tbl, uuid),
s as (select a.tbl, a.uuid as a, b.uuid as b, array_cosine_similarity(a.v, b.v) as sim from v a join v b on a.tbl = b.tbl and a.uuid <> b.uuid where array_cosine_similarity(a.v, b.v) >= 0.90),
r as (select *, row_number() over (partition by tbl, a order by sim desc, b) as no from s)
select distinct tbl, least(a, b) as uuid_a, greatest(a, b) as uuid_b from r where no <= 5
"""


def _hundredth(c: str) -> Column:
    """Whether the number that the first four hexadecimal digits of the id's MD5 make is divisible by 100."""
    return F.conv(F.substring(F.md5(c), 1, 4), 16, 10).cast("long") % 100 == 0


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar records, however far, of every hundredth record, among all records; all cells visited."""
    parts = []
    for table, vector in _VECTORS:
        near = neighbours.nearest(load(spark, sf_dir, table), "uuid", vector, k=5, conf=neighbours.MultiIndex(recall=1.0), asks=_hundredth("uuid"))
        parts.append(near.select(F.lit(table).alias("tbl"), F.col("query").alias("uuid"), F.col("neighbour").alias("other_uuid"), F.col("rank").cast("long").alias("rank")))
    return reduce(DataFrame.unionByName, parts)


def p1_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the true 5 neighbours of every hundredth record the index finds, without a floor and from 0.90."""
    parts = []
    for table, vector in _VECTORS:
        df = load(spark, sf_dir, table).select("uuid", vector)
        for floor in (None, 0.90):
            true, found = (neighbours.nearest(df, "uuid", vector, k=5, floor=floor, conf=neighbours.MultiIndex(recall=r), asks=_hundredth("uuid")).select("query", "neighbour") for r in (1.0, neighbours.MultiIndex.recall))
            both = true.join(found.withColumn("hit", F.lit(1)), ["query", "neighbour"], "left")
            parts.append(both.agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found")).select(F.lit(table).alias("tbl"), F.lit(floor).cast("double").alias("floor"), "n_true", "n_found", (F.col("n_found") / F.col("n_true")).alias("recall")))
    return reduce(DataFrame.unionByName, parts)


_P1_LISTS_SQL = """
with usable as (
  select distinct 'entity' as tbl, uuid, name_embedding::double[] as v from entity where len(name_embedding) = 64
  union select distinct 'relates_to', uuid, fact_embedding::double[] from relates_to where len(fact_embedding) = 64),
v as (select tbl, uuid, any_value(v)::double[64] as v from usable where len(list_filter(v, lambda x: isfinite(x))) = 64 and len(list_filter(v, lambda x: x <> 0)) > 0 group by tbl, uuid),
s as (select a.tbl, a.uuid as a, b.uuid as b, array_cosine_similarity(a.v, b.v) as sim from v a join v b on a.tbl = b.tbl and a.uuid <> b.uuid where ('0x' || substr(md5(a.uuid), 1, 4))::int % 100 = 0),
r as (select *, row_number() over (partition by tbl, a order by sim desc, b) as no from s)
select tbl, a as uuid, b as other_uuid, no as rank from r where no <= 5
"""


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every entity that a merge links with another one."""
    entity = load(spark, sf_dir, "entity")
    links = entity.select("uuid", bare_key(F.col("merged_into"), "entity").alias("into")).where("into is not null and into != uuid").distinct()
    known = links.join(entity.select(F.col("uuid").alias("into")), "into", "left_semi")
    return components.components(known, "uuid", "into").select(F.col("component").alias("component_uuid"), F.col("id").alias("uuid"))


_P2_SQL = r"""
with recursive links as (
  select distinct uuid as a, trim(regexp_replace(regexp_replace(trim(merged_into), '^entity:', ''), '^⟨(.*)⟩$', '\1')) as b from entity where merged_into is not null),
edges as (select a, b from links where a <> b and b in (select uuid from entity)),
both_ways as (select a, b from edges union select b, a from edges),
reach(id, other) as (select a, a from both_ways union select r.id, e.b from reach r join both_ways e on e.a = r.other)
select min(other) as component_uuid, id as uuid from reach group by id
"""


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of personal information in the episodes' content."""
    return pii.find_mentions(load(spark, sf_dir, "episode"), load(spark, sf_dir, "name_lexicon"))


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every episode's content with typed placeholders for the mentions."""
    return pii.redact_texts(load(spark, sf_dir, "episode"), load(spark, sf_dir, "name_lexicon"))


def _name_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity, alias = load(spark, sf_dir, "entity"), load(spark, sf_dir, "entity_alias")
    owner = bare_key(F.col("entity_uuid"), "entity")
    row = lambda df, role, rec, surface: df.select(F.lit(role).alias("role"), rec.alias("rec"), F.col("group_id").alias("grp"), surface.alias("surface"))
    surfaces = [
        row(entity, "name", F.col("uuid"), F.col("name")),
        row(entity.withColumn("other", F.explode("aliases")), "known", F.col("uuid"), F.col("other")),
        row(alias.where(owner.isNull()), "name", F.col("uuid"), F.col("alias")),
        row(alias.where(owner.isNotNull()), "known", owner, F.col("alias")),
    ]
    return names.link_variants(reduce(DataFrame.unionByName, surfaces), load(spark, sf_dir, "name_lexicon"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of entities and unresolved aliases of one group that denote the same person or organisation."""
    return names.record_pairs(_name_clusters(spark, sf_dir))


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every record that another spelling links, one row a record."""
    return names.record_groups(_name_clusters(spark, sf_dir))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of every pack spec, filled with all documents."""
    return packing.pack_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "pack_spec"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and their fill per pack spec."""
    return packing.fill_report(p8_packed(spark, sf_dir), load(spark, sf_dir, "pack_spec"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of each document in a mixture with the target shares."""
    return mixing.mix_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_target"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached shares of the mixture's sources."""
    return mixing.mix_report(p9_mix(spark, sf_dir), load(spark, sf_dir, "mix_target"))


def p9_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares that the fit of expected tokens reaches before labels are counted."""
    return mixing.soft_report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_target"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of template residue, filler, error pages and script notices."""
    return residue.residue_documents(load(spark, sf_dir, "documents")).select("doc_id")


QUERIES = {"p1_found": p1_found, "p1_neighbours": p1_neighbours, "p1_recall": p1_recall, "p2_found": p2_found, "p6_found": p6_found, "p6_redacted": p6_redacted, "p7_found": p7_found, "p7_groups": p7_groups, "p8_packed": p8_packed, "p8_report": p8_report, "p9_mix": p9_mix, "p9_report": p9_report, "p9_soft": p9_soft, "p10_found": p10_found}
ORACLE = {"p1_found": _P1_SQL, "p1_neighbours": _P1_LISTS_SQL, "p2_found": _P2_SQL}
