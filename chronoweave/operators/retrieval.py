"""Hybrid retrieval: vectors, BM25, rank fusion, admission, reranking and spreading activation."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions import text as T
from chronoweave.functions import vectors as V
from chronoweave.functions.decay import fan_damping

#: BM25 after Robertson and Zaragoza (2009), fusion constant, gates.
K1, BM25_B, RRF_K = 1.2, 0.75, 60
WORD = "[a-z0-9]+"


@dataclass(frozen=True)
class Search:
    limit: int = 10
    candidates: int = 50
    admit_cosine: float = 0.25
    admit_tokens: int = 2
    resurrect_cosine: float = 0.45
    spread_weight: float = 0.15
    seeds: int = 4
    mmr: float = 0.5


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Adds ``rank`` from 1. For candidate lists of bounded length: the window has no partition."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def vector_topk(df: DataFrame, key: str, column: str, vector: list[float], k: int, allowed: DataFrame | None = None) -> DataFrame:
    """The k most similar rows: ``key, score``. ``allowed`` (``key``) restricts candidates before ranking."""
    if allowed is not None:
        df = df.join(allowed, key, "left_semi")
    score = F.round(V.cosine_strict(F.col(column), V.literal(vector)), 9)
    return df.where(F.col(column).isNotNull()).select(F.col(key), score.alias("score")).where(~F.isnan("score")).orderBy(F.desc("score"), key).limit(k)


def _is(word: str):
    return lambda t: t == word


def bm25(df: DataFrame, key: str, column: str, query: str) -> DataFrame:
    """``key, score`` of the rows that share a word with the query.

    One pass counts rows, words and document frequencies of the query's words, a second scores; neither
    shuffles rows.
    """
    words = list(dict.fromkeys(re.findall(WORD, query.lower())))
    tokens = T.all_of(F.lower(F.coalesce(F.col(column), F.lit(""))), WORD)
    rows = df.select(F.col(key), tokens.alias("_t"))
    stats = rows.agg(F.count("*").alias("n"), F.avg(F.size("_t")).alias("avg"), *[F.count_if(F.array_contains("_t", w)).alias(f"d{i}") for i, w in enumerate(words)]).first()
    if not words or not stats.n:
        return rows.select(key, F.lit(0.0).alias("score")).limit(0)
    length = F.lit(K1 * (1 - BM25_B)) + F.size("_t") * F.lit(K1 * BM25_B / (stats.avg or 1.0))
    parts = []
    for i, w in enumerate(words):
        df_w = stats[f"d{i}"]
        idf = float(np.log(1 + (stats.n - df_w + 0.5) / (df_w + 0.5)))
        tf = F.size(F.filter("_t", _is(w)))
        parts.append(F.lit(idf) * tf * (K1 + 1) / (tf + length))
    score = sum(parts[1:], parts[0])
    return rows.where(F.arrays_overlap("_t", F.array(*map(F.lit, words)))).select(key, F.round(score, 6).alias("score"))


def fuse(lists: list[DataFrame], key: str) -> DataFrame:
    """Reciprocal-rank fusion of lists with ``rank``; ``ordinal`` is the place of the first sight, list by list."""
    tagged = [d.select(key, "rank", F.lit(i * 1_000_000).alias("_base")) for i, d in enumerate(lists)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t)
    return both.groupBy(key).agg(F.sum(F.lit(1.0) / (RRF_K + F.col("rank"))).alias("score"), F.min(F.col("_base") + F.col("rank")).alias("ordinal"))


def admit(candidates: DataFrame, query: str, vector: list[float], conf: Search = Search()) -> DataFrame:
    """Candidates near enough by cosine or with enough of the query's words; a blank query admits all."""
    if not query.strip():
        return candidates
    tokens = T.cue_tokens(F.lit(query))
    near = V.cosine_strict(F.col("fact_embedding"), V.literal(vector)) >= conf.admit_cosine
    return candidates.where(F.coalesce(near, F.lit(False)) | (T.lexical_matches(tokens, F.col("fact"), F.col("pred"), F.col("canonical")) >= conf.admit_tokens))


def spread(candidates: DataFrame, conf: Search = Search()) -> DataFrame:
    """``uuid, score`` after candidates got a boost from seeds they share an endpoint or episode with.

    ``candidates``: ``uuid, score, ordinal, subj, obj, episodes``. The boost counts per seed and shared identity.
    """
    ident = F.array_distinct(F.concat(F.transform(F.array("subj", "obj"), lambda x: F.concat(F.lit("entity:"), x)), F.transform("episodes", lambda x: F.concat(F.lit("episode:"), x))))
    ids = candidates.select("uuid", F.explode(ident).alias("ident")).where("ident is not null")
    fans = ids.groupBy("ident").agg(F.count("*").alias("fan"))
    seeds = candidates.orderBy(F.desc("score"), "ordinal").limit(conf.seeds).select(F.col("uuid").alias("seed"))
    seeded = ids.join(seeds, ids["uuid"] == seeds["seed"]).select("seed", "ident")
    boost = ids.join(seeded, "ident").join(fans, "ident").where("uuid != seed").groupBy("uuid").agg(F.sum(F.lit(conf.spread_weight) * fan_damping(F.col("fan"))).alias("boost"))
    return candidates.join(boost, "uuid", "left").select("uuid", (F.col("score") + F.coalesce("boost", F.lit(0.0))).alias("score"), "ordinal")


def by_mentions(candidates: DataFrame) -> DataFrame:
    return ranked(candidates, F.size("episodes").desc(), F.col("ordinal"))


def by_overlap(candidates: DataFrame, query: str) -> DataFrame:
    """The offline cross-encoder: share of the query's words in the passage."""
    words = F.array(*[F.lit(w) for w in dict.fromkeys(query.lower().split())])
    share = F.size(F.array_intersect(words, F.array_distinct(F.split(F.lower("fact"), r"\s+")))) / F.size(words)
    return ranked(candidates.withColumn("overlap", F.round(share, 6)), F.desc("overlap"), F.col("ordinal"))


def mmr_order(query: np.ndarray, vectors: list[np.ndarray | None], lam: float, limit: int) -> list[int]:
    """Greedy choice of relevant and unlike candidates; those without a vector come in their order when nothing else is left."""

    def cos(a: np.ndarray, b: np.ndarray) -> float:
        d = np.linalg.norm(a) * np.linalg.norm(b)
        return float(a[: len(b)] @ b[: len(a)] / d) if d else 0.0

    left, chosen = list(range(len(vectors))), []
    gain = {i: cos(query, v) for i, v in enumerate(vectors) if v is not None}
    worst = dict.fromkeys(gain, 0.0)
    while left and len(chosen) < limit:
        best = max((i for i in left if i in gain), key=lambda i: (lam * gain[i] - (1 - lam) * worst[i], -i), default=left[0])
        chosen.append(best)
        left.remove(best)
        if best in gain:
            for i in left:
                if i in gain:
                    worst[i] = max(worst[i], cos(vectors[best], vectors[i]))
    return chosen


def by_mmr(candidates: DataFrame, vector: list[float], conf: Search = Search()) -> DataFrame:
    """Maximal marginal relevance over one candidate list, which is bounded by the candidate limit."""
    query = np.array(vector, float)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ordinal")
        vecs = [None if v is None else np.asarray(v, float) for v in pdf["fact_embedding"]]
        order = mmr_order(query, vecs, conf.mmr, conf.limit)
        return pd.DataFrame({"uuid": pdf["uuid"].to_numpy()[order], "rank": np.arange(1, len(order) + 1)})

    return candidates.select("uuid", "ordinal", "fact_embedding", F.lit(0).alias("g")).groupBy("g").applyInPandas(lambda pdf: run(pdf), "uuid string, rank int")


def focal_depths(links: DataFrame, focal: str) -> DataFrame:
    """``node, depth`` (1 or 2) of the nodes around a focal node over undirected ``links`` (``src, dst``)."""
    both = links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    one = both.where(F.col("src") == focal).select(F.col("dst").alias("node")).where(F.col("node") != focal)
    two = both.join(one.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).where(F.col("node") != focal)
    return one.withColumn("depth", F.lit(1)).unionByName(two.withColumn("depth", F.lit(2))).groupBy("node").agg(F.min("depth").alias("depth"))


def by_distance(candidates: DataFrame, depths: DataFrame) -> DataFrame:
    """Nearest endpoint first, then score; endpoints out of reach count 99."""
    d = lambda side: depths.select(F.col("node").alias(side), F.col("depth").alias(f"d_{side}"))
    j = candidates.join(d("subj"), "subj", "left").join(d("obj"), "obj", "left").withColumn("depth", F.least(F.coalesce("d_subj", F.lit(99)), F.coalesce("d_obj", F.lit(99))))
    return ranked(j, F.col("depth"), F.desc("score"), F.col("ordinal"))


def hybrid(facts: DataFrame, query: str, vector: list[float], conf: Search = Search()) -> DataFrame:
    """Candidates of both lists with fused ``score`` and ``ordinal``, and the facts' columns."""
    vec = ranked(vector_topk(facts, "uuid", "fact_embedding", vector, conf.candidates), F.desc("score"), F.col("uuid"))
    lex = ranked(bm25(facts, "uuid", "fact", query).orderBy(F.desc("score"), "uuid").limit(conf.candidates), F.desc("score"), F.col("uuid"))
    return facts.join(fuse([vec, lex], "uuid"), "uuid")


def top(scored: DataFrame, limit: int) -> DataFrame:
    return scored.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "ordinal").limit(limit)


def resurrect(silent: DataFrame, vector: list[float], conf: Search = Search()) -> DataFrame:
    """The silent memory to wake: the nearest of four, if near enough."""
    return vector_topk(silent, "uuid", "fact_embedding", vector, conf.seeds).where(F.col("score") >= conf.resurrect_cosine).orderBy(F.desc("score"), "uuid").limit(1)


def similar_edges(facts: DataFrame, query: str, vector: list[float], subj: str, obj: str, limit: int = 10) -> DataFrame:
    """Facts like a new one: by vector, by text, and with its object or else its subject; each once, in that order."""
    vec = ranked(vector_topk(facts, "uuid", "fact_embedding", vector, limit), F.desc("score"), F.col("uuid")).select("uuid", "rank", F.lit(0).alias("list"))
    lex = ranked(bm25(facts, "uuid", "fact", query).orderBy(F.desc("score"), "uuid").limit(limit), F.desc("score"), F.col("uuid")).select("uuid", "rank", F.lit(1).alias("list"))
    co = facts.where((F.col("obj") == obj) | (F.col("subj") == subj)).select("uuid", (F.col("obj") != obj).cast("int").alias("_o")).orderBy("_o", "uuid").limit(2 * limit)
    same = ranked(co, F.col("_o"), F.col("uuid")).select("uuid", "rank", F.lit(2).alias("list"))
    return vec.unionByName(lex).unionByName(same).groupBy("uuid").agg(F.min(F.col("list") * 1000 + F.col("rank")).alias("ordinal"))
