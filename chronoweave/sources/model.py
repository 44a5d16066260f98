"""The memory graph's record kinds with their defaults, one row a record.

Rows that repeat a uuid are one record: of facts the row recalled most often stands, of other kinds the first
in the order of their remaining columns. Rows without a uuid are no record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from chronoweave.sources.tables import bare_key, load, trimmed


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per key, the first by ``order`` and then by all its other columns, so equal tables give equal rows."""
    rest = F.xxhash64(*[F.to_json(F.struct(c)) if isinstance(df.schema[c].dataType, MapType) else F.col(c) for c in sorted(df.columns)])
    at = Window.partitionBy(key).orderBy(*order, rest)
    return df.where(F.col(key).isNotNull()).withColumn("_row", F.row_number().over(at)).where("_row = 1").drop("_row")


def optional(df: DataFrame, column: str, default: Column) -> Column:
    """A column that a table may lack; null and a missing column give the default."""
    return (F.coalesce(F.col(column), default) if column in df.columns else default).alias(column)


def text_or(c: str, default: str) -> Column:
    """A text column; blank and null give the default."""
    v = trimmed(F.col(c))
    return F.when(v != "", v).otherwise(F.lit(default))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with bare endpoints ``subj`` and ``obj`` and the predicate ``pred`` in lower case."""
    rows = latest(load(spark, sf_dir, "relates_to"), "uuid", F.coalesce("recall_count", F.lit(0)).desc())
    pred = F.lower(trimmed(F.coalesce("name", F.lit(""))))
    ts = lambda c: F.col(c).cast("timestamp").alias(c)
    return rows.select(
        "uuid", "group_id", F.coalesce("source_node_uuid", bare_key(F.col("in_link"), "entity")).alias("subj"), F.coalesce("target_node_uuid", bare_key(F.col("out_link"), "entity")).alias("obj"),
        pred.alias("pred"), F.coalesce("fact", F.lit("")).alias("fact"), "fact_embedding", F.coalesce("episodes", F.array().cast("array<string>")).alias("episodes"),
        ts("valid_at"), ts("invalid_at"), ts("expired_at"), ts("created_at"), text_or("status", "active").alias("status"), text_or("polarity", "positive").alias("polarity"),
        text_or("source_type", "user").alias("source_type"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("singleton", F.lit(False)).alias("singleton"),
        F.when(F.lower(text_or("canonical_name", "")) != "", F.lower(text_or("canonical_name", ""))).otherwise(pred).alias("canonical"), "qualifiers",
        F.coalesce("reinforcement_count", F.lit(1)).alias("reinforcement_count"), F.coalesce("recall_count", F.lit(0)).alias("recall_count"), text_or("stability", "episodic").alias("stability"),
        optional(rows, "memory_class", F.lit("objective")), optional(rows, "is_belief", F.lit(False)), optional(rows, "domain", F.lit("")),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest(load(spark, sf_dir, "entity"), "uuid", F.col("merged_into").asc_nulls_last())
    empty = F.array().cast("array<string>")
    return rows.select(
        "uuid", "group_id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("labels", F.array(F.lit("Entity"))).alias("labels"), "name_embedding",
        F.col("created_at").cast("timestamp").alias("created_at"), "canonical_name", F.coalesce("aliases", empty).alias("aliases"), F.coalesce("salience", F.lit(0.0)).alias("salience"),
        F.coalesce("mention_count", F.lit(0)).alias("mention_count"), F.col("last_seen_at").cast("timestamp").alias("last_seen_at"), optional(rows, "domain", F.lit("")),
    )


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest(load(spark, sf_dir, "episode"), "uuid", F.col("created_at"), F.col("content").asc_nulls_last())
    empty = F.array().cast("array<string>")
    return rows.select(
        "uuid", "group_id", "name", text_or("source", "message").alias("source"), "source_description", F.coalesce("content", F.lit("")).alias("content"), F.col("created_at").cast("timestamp").alias("created_at"),
        F.coalesce("entity_edges", empty).alias("entity_edges"), F.coalesce("ingestion_complete", F.lit(False)).alias("ingestion_complete"), F.col("cognition_processed_at").cast("timestamp").alias("cognition_processed_at"), "affect", "interaction_pattern", "cognition_version",
    )


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest(load(spark, sf_dir, "entity_alias"), "uuid", F.col("created_at"))
    return rows.select("uuid", "group_id", "alias", "normalized_alias", bare_key(F.col("entity_uuid"), "entity").alias("entity_uuid"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.col("created_at").cast("timestamp").alias("created_at"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "relation_frame").where("canonical_name is not null")


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest(load(spark, sf_dir, "extracted_fact"), "fact_id", F.col("episode_uuid"))
    return rows.select(
        "fact_id", "episode_uuid", "group_id", F.coalesce(trimmed(F.col("subject")), F.lit("")).alias("subject"), F.lower(F.coalesce(trimmed(F.col("predicate")), F.lit(""))).alias("predicate"), F.coalesce(trimmed(F.col("object_name")), F.lit("")).alias("object_name"),
        F.lower(text_or("fact_operation", "assert")).alias("operation"), F.lower(text_or("memory_class", "objective")).alias("memory_class"), F.coalesce("singleton", F.lit(False)).alias("singleton"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
    )
