"""The memory graph as one object: reads return DataFrames, writes return the rows to commit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import extract
from chronoweave.functions.text import normalize_alias, query_ngrams
from chronoweave.operators import cognition, graph, identity, participants, predicates, resolution, retrieval, state
from chronoweave.sources import model

DEPTH = {"fast": 10, "normal": 25, "deep": 50}


def _slot(*parts: str) -> Column:
    """A key that tells null parts and the borders of parts apart."""
    return F.to_json(F.array(*[F.col(p).cast("string") for p in parts]))


@dataclass
class MemoryGraph:
    """Tables of one graph. ``now`` is a parameter everywhere, so a read gives the same rows when it is repeated."""

    facts: DataFrame
    entities: DataFrame
    episodes: DataFrame
    aliases: DataFrame
    frames: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, folder: str, group: str | None = None) -> MemoryGraph:
        tables = [f(spark, folder) for f in (model.facts, model.entities, model.episodes, model.aliases)]
        if group is not None:
            tables = [t.where(F.col("group_id") == group) for t in tables]
        return cls(*tables, model.frames(spark, folder))

    # State

    def current_facts(self, now: str) -> DataFrame:
        return state.current_facts(self.facts, predicates.instant(now))

    def current_fact(self, subj: str, relation: str, now: str) -> DataFrame:
        return self.current_facts(now).where((F.col("subj") == subj) & (F.col("canonical") == relation)).orderBy(F.col("valid_at").desc_nulls_last(), "uuid").limit(1)

    def facts_as_of(self, t: str) -> DataFrame:
        return state.facts_as_of(self.facts, predicates.instant(t))

    def state_as_of(self, t: str) -> DataFrame:
        return state.state_as_of(self.facts, predicates.instant(t))

    def profile(self, now: str) -> DataFrame:
        return state.current_profile(self.facts, predicates.instant(now))

    def conflicts(self) -> DataFrame:
        return self.facts.where("status = 'needs_resolution'")

    # Retrieval

    def search(self, query: str, vector: list[float], now: str, conf: retrieval.Search = retrieval.Search(), filters: predicates.EdgeFilter | None = None, allowed: DataFrame | None = None, rerank: str = "rrf", focal: str | None = None, decay: bool = False) -> DataFrame:
        """Hybrid search: candidates, fusion, validity, filters, admission, reranking, decay and spreading, limit.

        ``allowed`` (``uuid``) restricts the facts before candidates are drawn. ``rerank`` is ``rrf``, ``mentions``,
        ``cross_encoder`` or ``mmr``; a focal node goes before any of them. A blank query finds nothing.
        """
        facts = self.facts if allowed is None else self.facts.join(allowed.select("uuid"), "uuid", "left_semi")
        if not query.strip():
            return facts.limit(0).select("uuid", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("ordinal"))
        t = predicates.instant(now)
        found = retrieval.hybrid(facts, query, vector, conf).where(predicates.still_valid(t))
        if filters is not None:
            found = found.where(predicates.edge_passes(filters, facts.schema))
        if decay:
            strong = cognition.strength(retrieval.admit(found, query, vector, conf), t).where("effective > 0").withColumn("score", F.col("score") * F.col("effective"))
            return retrieval.top(retrieval.spread(strong, conf), conf.limit)
        if focal is not None:
            depths = retrieval.focal_depths(self.facts.select(F.col("subj").alias("src"), F.col("obj").alias("dst")), focal)
            ranked = retrieval.by_distance(found, depths)
        elif rerank == "rrf":
            return retrieval.top(found.select("uuid", "score", "ordinal"), conf.limit)
        elif rerank == "mmr":
            ranked = found.drop("rank").join(retrieval.by_mmr(found, vector, conf), "uuid")
        else:
            ranked = {"mentions": retrieval.by_mentions, "cross_encoder": lambda c: retrieval.by_overlap(c, query)}[rerank](found)
        return ranked.where(F.col("rank") <= conf.limit).select("uuid", "score", F.col("rank").cast("long").alias("ordinal"))

    def search_depth(self, query: str, vector: list[float], now: str, depth: str = "normal") -> DataFrame:
        if depth not in DEPTH:
            raise ValueError(f"unknown depth: {depth}")
        return self.search(query, vector, now, retrieval.Search(limit=DEPTH[depth]))

    def mentioned(self, query: str) -> DataFrame:
        """Entities that phrases of a query name, without creating any."""
        words = self.entities.sparkSession.range(1).select(F.explode(query_ngrams(F.lit(query))).alias("mention"))
        names = words.select(normalize_alias(F.col("mention")).alias("key")).where("key != ''").distinct()
        known = self.entities.select("uuid", normalize_alias(F.col("name")).alias("key")).unionByName(self.aliases.where("entity_uuid is not null").select(F.col("entity_uuid").alias("uuid"), normalize_alias(F.col("alias")).alias("key")))
        return known.join(names, "key", "left_semi").select("uuid").distinct()

    def recall_as_of(self, query: str, t: str, limit: int = 20) -> DataFrame:
        """What held at ``t`` about the entities a query names, newest first."""
        ego = self.mentioned(query)
        held = self.state_as_of(t)
        touch = held.select(F.col("uuid").alias("fact"), F.explode(F.array("subj", "obj")).alias("uuid")).join(ego, "uuid", "left_semi").select(F.col("fact").alias("uuid")).distinct()
        return held.join(touch, "uuid", "left_semi").orderBy(F.col("valid_at").desc_nulls_last(), "uuid").limit(limit)

    # Writes

    def extract(self, episodes: DataFrame) -> DataFrame:
        """Facts the offline extractor reads from episodes, repaired and with resolved relations and names."""
        raw = extract.facts(episodes, "content", "uuid", "group_id", "created_at").withColumnRenamed("uuid", "episode")
        fixed = resolution.repair(raw, F.lit(None).cast("string"))
        framed = fixed.join(resolution.resolve_frames(fixed.select("group_id", "predicate").distinct(), self.frames), ["group_id", "predicate"])
        names = framed.select("group_id", F.explode(F.array("subject", "object_name")).alias("mention")).distinct()
        ids = resolution.resolve_names(names, self.aliases, self.entities).select("group_id", "mention", F.coalesce("entity_uuid", identity.import_id(F.concat_ws(":", F.lit("entity"), "group_id", normalize_alias(F.col("mention"))))).alias("id"))
        end = lambda c, to: ids.select("group_id", F.col("mention").alias(c), F.col("id").alias(to))
        return framed.join(end("subject", "subj"), ["group_id", "subject"]).join(end("object_name", "obj"), ["group_id", "object_name"])

    def add_facts(self, new: DataFrame) -> DataFrame:
        """Slots after new assertions (``group_id, subj, canonical, obj, created_at, valid_at, invalid_at``), in arrival order."""
        cols = ["group_id", "subj", "canonical", "obj", "created_at", "valid_at", "invalid_at"]
        touched = new.select("group_id", "subj", "canonical").distinct()
        log = self.facts.join(touched, ["group_id", "subj", "canonical"], "left_semi").select(cols).unionByName(new.select(cols))
        us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
        return state.replay(log.select(_slot("group_id", "subj", "canonical").alias("slot"), us("created_at").alias("ord"), "obj", F.coalesce(us("valid_at"), us("created_at")).alias("start_us"), us("invalid_at").alias("end_us")))

    def remove_episodes(self, gone: DataFrame) -> DataFrame:
        return state.remove_episodes(self.facts, gone)

    # Views

    def read(self, view: str, settings: predicates.GraphRead | None = None, rows: int | None = None) -> tuple[DataFrame, DataFrame]:
        return graph.read_graph(self.facts, self.entities, view, settings, rows)

    def explain(self) -> DataFrame:
        return graph.explain(self.facts, self.entities, self.frames)

    def communities(self) -> DataFrame:
        return graph.communities(self.facts)

    def inspect(self) -> dict[str, DataFrame]:
        return {
            "counts": graph.inspect_counts(self.facts), "checks": graph.inspection(self.facts, self.entities, self.episodes, self.frames), "orphan_entities": graph.orphan_entities(self.entities, self.facts), "orphan_episodes": graph.orphan_episodes(self.episodes, self.facts),
            "duplicates": graph.duplicate_candidates(self.entities), "conflicts": self.conflicts(),
        }

    def visible_to(self, actor: str, refs: DataFrame) -> DataFrame:
        return participants.visible(self.facts, refs, actor)
