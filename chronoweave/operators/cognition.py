"""Batch passes over a graph: affect, reinforcement, weights, silence, traits, patterns, consolidation, topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions import decay as D
from chronoweave.functions import text as T

#: Fixed values: (word, emotion, polarity, weight).
AFFECT = (
    ("frustrated", "frustration", -0.7, 1.0), ("annoyed", "frustration", -0.5, 0.8), ("angry", "frustration", -0.8, 1.0), ("stuck", "frustration", -0.5, 0.7), ("hate", "frustration", -0.7, 0.8),
    ("tired", "fatigue", -0.4, 0.6), ("exhausted", "fatigue", -0.7, 0.9), ("sad", "sadness", -0.6, 0.8), ("worried", "anxiety", -0.5, 0.7), ("anxious", "anxiety", -0.6, 0.8), ("nervous", "anxiety", -0.4, 0.6), ("embarrassed", "embarrassment", -0.5, 0.7),
    ("excited", "excitement", 0.7, 0.9), ("love", "excitement", 0.7, 0.9), ("happy", "joy", 0.7, 0.9), ("great", "joy", 0.4, 0.5), ("awesome", "excitement", 0.7, 0.8), ("amazing", "excitement", 0.7, 0.8), ("proud", "pride", 0.7, 0.9), ("confident", "confidence", 0.6, 0.8), ("winning", "excitement", 0.6, 0.7),
    ("urgent", "urgency", 0.0, 0.9), ("asap", "urgency", 0.0, 0.9), ("deadline", "urgency", -0.2, 0.8), ("confused", "uncertainty", -0.3, 0.7), ("unsure", "uncertainty", -0.2, 0.6), ("maybe", "uncertainty", -0.1, 0.4),
)
#: Relations that say nothing about a character.
NO_TRAIT = ("has_trait", "pursues_goal", "is_age", "has_birthday", "has_age", "is_a", "is_named", "is_called", "is_self", "is_aka", "mentions_with")
#: Words that are no topic.
NO_TOPIC = (
    "have", "with", "this", "that", "from", "user", "also", "into", "their", "there", "about", "they",
    "your", "more", "much", "some", "what", "when", "would", "could", "should", "really", "actually",
)
#: Memory classes that can tell a trait.
TRAIT_CLASSES = ("objective", "preference", "style", "trait", "sentiment")


def lexicon(df: DataFrame, extra: tuple[tuple[str, str, float, float], ...] = ()) -> DataFrame:
    rows = [(w, e, float(p), float(x)) for w, e, p, x in (*AFFECT, *extra)]
    return df.sparkSession.createDataFrame(rows, "word string, emotion string, polarity double, weight double")


def affect(episodes: DataFrame, words: DataFrame) -> DataFrame:
    """The dominant emotion of each episode with an emotional word, its weighted polarity and its intensity.

    Dominant is the emotion of the greatest weight, of equal ones the first in the text; other emotions do not count.
    Episodes without such a word, null and empty texts give no row.
    """
    tokens = episodes.select("uuid", F.posexplode(T.all_of(F.lower("content"), "[a-z']+")).alias("pos", "word"))
    hits = tokens.join(words, "word")
    per = hits.groupBy("uuid", "emotion").agg(F.sum("weight").alias("w"), F.min("pos").alias("first"), F.sum(F.col("polarity") * F.col("weight")).alias("pw"))
    out = per.groupBy("uuid").agg(F.max_by(F.struct("emotion", "w", "pw"), F.struct(F.round("w", 9), -F.col("first"))).alias("top"))
    return out.select("uuid", "top.emotion", F.round(F.col("top.pw") / F.greatest(F.lit(1e-6), F.col("top.w")), 3).alias("polarity"), F.round(F.least(F.lit(1.0), F.col("top.w") / 2), 3).alias("intensity"))


def reinforcement(facts: DataFrame, episodes: DataFrame) -> DataFrame:
    """Distinct source episodes of a fact, the days they span, and the stability that earns."""
    j = facts.select("uuid", "stability", F.explode(F.array_distinct("episodes")).alias("episode")).join(episodes.select(F.col("uuid").alias("episode"), "created_at"), "episode")
    g = j.groupBy("uuid", "stability").agg(F.count("*").alias("n_episodes"), ((F.unix_micros(F.max("created_at")) - F.unix_micros(F.min("created_at"))) / 8.64e10).alias("days"))
    new = F.when(F.col("stability") == "consolidated", "consolidated").when((F.col("n_episodes") >= 7) & (F.col("days") >= 7), "persistent").when((F.col("n_episodes") >= 3) & (F.col("stability") == "episodic"), "reinforced").otherwise(F.col("stability"))
    return g.select("uuid", "n_episodes", F.round("days", 6).alias("span_days"), new.alias("stability"))


def fallback_events(facts: DataFrame) -> Column:
    """Activation events of a fact without a log: its reinforcements and recalls at its effective time."""
    at = F.coalesce("valid_at", "created_at")
    return F.array(F.struct(at.alias("at"), (F.col("reinforcement_count") * D.REINFORCE_WEIGHT).alias("weight")), F.struct(at.alias("at"), (F.col("recall_count") * D.RECALL_WEIGHT).alias("weight")))


def strength(facts: DataFrame, now: Column) -> DataFrame:
    """``level``, ``alive`` and ``effective`` of every fact from its counters."""
    level = D.base_level(fallback_events(facts), F.lit(None).cast("double"), F.col("created_at"), now)
    safe = D.protected(F.col("stability"))
    return facts.withColumn("level", level).withColumn("alive", D.vitality(F.col("level"), safe)).withColumn("effective", D.effective_confidence(F.col("confidence"), F.col("alive"), safe))


def associative_weights(strong: DataFrame) -> DataFrame:
    """Weight of active facts by effective confidence and how often their endpoints and episodes are touched."""
    live = strong.where("status = 'active'")
    ends = live.select("uuid", F.explode(F.array("subj", "obj")).alias("id")).where("id is not null")
    eps = live.select("uuid", F.explode("episodes").alias("id"))
    touch = lambda rows: rows.join(rows.groupBy("id").agg(F.count("*").alias("n")), "id").groupBy("uuid").agg(F.sum("n").alias("n"))
    touched = touch(ends).unionByName(touch(eps)).groupBy("uuid").agg(F.sum("n").alias("touched"))
    w = D.clamp(F.col("effective") * (1 + F.least(F.lit(1.0), F.coalesce("touched", F.lit(0)) / 12)), 0.0, 4.0)
    return live.join(touched, "uuid", "left").select("uuid", F.coalesce("touched", F.lit(0)).alias("touched"), F.round(w, 6).alias("weight"))


def silence(strong: DataFrame, now: Column, days: int = 30, most: int = 500, by: tuple[str, ...] = ("group_id",)) -> DataFrame:
    """Faint, unprotected facts among the oldest ``most`` active ones of each ``by`` that are older than ``days``.

    The sweep is taken before protected and strong facts are left out. Ties go to the smaller uuid.
    """
    old = strong.where((F.col("status") == "active") & (D.hours(now, F.col("created_at")) / 24 > days))
    if by:
        old = old.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("created_at", "uuid"))).where(F.col("_n") <= most)
    else:
        old = old.orderBy("created_at", "uuid").limit(most)
    return old.where(~D.protected(F.col("stability")) & (F.col("level") < D.SILENCE)).select("uuid", F.round("level", 6).alias("level"))


def trait_candidates(facts: DataFrame, most: int = 12) -> DataFrame:
    """What a subject keeps doing: (relation, object) reinforced twice, relations with three facts (``*``); the strongest a subject.

    Beliefs, one-valued facts, facts without a relation and memory classes that tell no trait do not count. Of equally
    strong candidates pairs come first, then the smaller relation and object.
    """
    live = facts.where(~F.col("canonical").isin(*NO_TRAIT) & (F.col("canonical") != "") & ~F.col("singleton") & (F.col("status") == "active") & ~F.col("is_belief") & F.col("memory_class").isin(*TRAIT_CLASSES))
    once = F.greatest(F.col("reinforcement_count"), F.lit(1))
    by_object = live.groupBy("group_id", "subj", "canonical", "obj").agg(F.sum(once).alias("strength")).where("strength >= 2").select("group_id", "subj", "canonical", "obj", "strength", F.lit(0).alias("_kind"))
    by_relation = live.groupBy("group_id", "subj", "canonical").agg(F.count("*").alias("n"), F.sum(once).alias("strength")).where("n >= 3").select("group_id", "subj", "canonical", F.lit("*").alias("obj"), "strength", F.lit(1).alias("_kind"))
    at = Window.partitionBy("group_id", "subj").orderBy(F.desc("strength"), "_kind", "canonical", "obj")
    return by_object.unionByName(by_relation).withColumn("place", F.row_number().over(at)).where(F.col("place") <= most).drop("_kind")


def interaction_patterns(episodes: DataFrame) -> DataFrame:
    """The kind of each episode, given the one before it in its group."""
    prior = F.lag("content").over(Window.partitionBy("group_id").orderBy("created_at", "uuid"))
    return episodes.withColumn("_prior", prior).select("uuid", "group_id", "created_at", T.classify_episode(F.col("content"), F.col("_prior")).alias("pattern"))


def dominant_patterns(patterns: DataFrame, last: int = 8, least: int = 5) -> DataFrame:
    """The pattern that rules the last episodes of a group."""
    recent = patterns.withColumn("_n", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("created_at"), F.desc("uuid")))).where(F.col("_n") <= last)
    counts = recent.groupBy("group_id", "pattern").agg(F.count("*").alias("hits"))
    top = counts.withColumn("_n", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("hits"), "pattern"))).where("_n = 1")
    return top.where((F.col("hits") >= least) & (F.col("pattern") != "one_off_query")).select("group_id", "pattern", "hits", F.round(F.least(F.lit(1.0), 0.5 + 0.06 * F.col("hits")), 2).alias("confidence"))


def consolidation(facts: DataFrame, episodes: DataFrame, least: int = 8, days: int = 14) -> DataFrame:
    """Fact keys with many sources over a long time: their mean confidence raised by 0.1, and their most confident fact.

    ``facts`` has ``fact_key``; only active facts that are not consolidated yet and have a key count. A source counts even if its
    episode is gone; the span is of those with a time, of which there must be two. Ties go to the smaller uuid.
    """
    live = facts.where("status = 'active' and stability != 'consolidated' and fact_key != ''")
    told = live.select("group_id", "fact_key", F.explode("episodes").alias("episode")).distinct()
    timed = told.join(episodes.select(F.col("uuid").alias("episode"), "created_at"), "episode", "left")
    spans = timed.groupBy("group_id", "fact_key").agg(F.count("*").alias("n_episodes"), F.count("created_at").alias("n_timed"), ((F.unix_micros(F.max("created_at")) - F.unix_micros(F.min("created_at"))) / 8.64e10).alias("days"))
    means = live.groupBy("group_id", "fact_key").agg(F.avg("confidence").alias("mean"), F.count("*").alias("n_facts"), F.min_by("uuid", F.struct(-F.col("confidence"), "uuid")).alias("clearest"))
    out = spans.where((F.col("n_episodes") >= least) & (F.col("n_timed") >= 2) & (F.col("days") >= days)).join(means, ["group_id", "fact_key"])
    return out.select("group_id", "fact_key", "n_facts", "n_episodes", F.round(F.least(F.lit(1.0), F.col("mean") + 0.1), 6).alias("confidence"), "clearest")


def stagnant(strong: DataFrame, most_effective: float = 0.0, least: int = 5, most: int = 120) -> DataFrame:
    """Buckets of at least ``least`` faded facts of a subject, memory class and domain, each told in one sentence.

    Of each group the ``most`` oldest active facts that are not consolidated are looked at. The domain is the fact's, else its
    relation, else ``misc``. The sentence names the five oldest; only these are gathered.
    """
    live = strong.where("status = 'active' and stability != 'consolidated'").withColumn("_n", F.row_number().over(Window.partitionBy("group_id").orderBy("created_at", "uuid"))).where(F.col("_n") <= most)
    bucket = F.when(F.col("domain") != "", F.col("domain")).when(F.col("canonical") != "", F.col("canonical")).when(F.col("pred") != "", F.col("pred")).otherwise("misc")
    faded = live.where((F.col("effective") <= most_effective) & ~D.protected(F.col("stability"))).withColumn("bucket", bucket)
    said = F.when(F.trim("fact") != "", F.trim("fact")).when(F.col("pred") != "", F.col("pred"))
    keys = ["group_id", "subj", "memory_class", "bucket"]
    at = Window.partitionBy(*keys).orderBy("created_at", "uuid")
    told = faded.withColumn("said", said).withColumn("_n", F.count("said").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.when(F.col("said").isNotNull() & (F.col("_n") <= 5), F.struct("_n", "said"))
    lines = told.groupBy(*keys).agg(F.count("*").alias("n_facts"), F.count("said").alias("n_said"), F.transform(F.array_sort(F.collect_list(first)), lambda x: x["said"]).alias("lines")).where(F.col("n_facts") >= least)
    rest = F.when(F.col("n_said") > 5, F.concat(F.lit("; and "), (F.col("n_said") - 5).cast("string"), F.lit(" related older facts"))).otherwise("")
    summary = F.when(F.col("n_said") == 0, F.lit("Low-vitality memory cluster.")).otherwise(F.concat(F.lit("Low-vitality memory cluster: "), F.array_join("lines", "; "), rest))
    return lines.select(*keys, "n_facts", summary.alias("summary"))


def term_ranks(texts: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The ``most`` most frequent words of four letters or more per ``keys``; ties go to the word seen first.

    ``texts`` has ``keys``, ``text`` and an order of its rows by ``at`` and ``id``.
    """
    words = texts.select(*keys, "at", "id", F.posexplode(T.all_of(F.lower("text"), "[a-z]{4,}")).alias("pos", "term")).where(~F.col("term").isin(*NO_TOPIC))
    counts = words.groupBy(*keys, "term").agg(F.count("*").alias("n"), F.min(F.struct("at", "id", "pos")).alias("first"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "first"))).where(F.col("place") <= most).drop("first")


def top_terms(facts: DataFrame, most: int = 5) -> DataFrame:
    """The most frequent words of each group's facts, in the order of their creation."""
    return term_ranks(facts.select("group_id", F.col("created_at").alias("at"), F.col("uuid").alias("id"), F.col("fact").alias("text")), ["group_id"], most)


def bounded_activation(events: DataFrame, keys: list[str], at: str, weight: Column, now: Column) -> DataFrame:
    """Activation of event logs: the last eight events exactly, the rest by total weight."""
    rows = events.select(*keys, F.col(at).cast("timestamp").alias("at"), weight.alias("weight")).where("at is not null")
    recent = Window.partitionBy(*keys).orderBy(F.desc("at"), F.desc("weight"))
    sums = rows.groupBy(*keys).agg(F.sum("weight").alias("total"), F.min("at").alias("created"), F.count("*").alias("n_events"))
    last = rows.withColumn("_n", F.row_number().over(recent)).where(F.col("_n") <= D.RING).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "weight"))).alias("events"))
    level = D.base_level(F.col("events"), F.col("total"), F.col("created"), now)
    return sums.join(last, keys).select(*keys, "n_events", F.size("events").alias("n_exact"), F.round("total", 6).alias("total_weight"), F.round(level, 6).alias("level"), F.round(D.vitality(level, F.lit(False)), 6).alias("vitality"))


def debounce(events: DataFrame, key: str, at: str, order: str, idle_seconds: int, most: int) -> DataFrame:
    """Batches of pending events: a batch closes after an idle time or when ``most`` events wait."""
    w = Window.partitionBy(key).orderBy(at, order)
    gap = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))) > idle_seconds * 1_000_000
    s = events.select(key, at, order, F.coalesce(gap, F.lit(True)).cast("long").alias("new")).withColumn("session", F.sum("new").over(w))
    n = s.withColumn("n", F.row_number().over(Window.partitionBy(key, "session").orderBy(at, order)))
    batch = F.floor((F.col("n") - 1) / most)
    return n.groupBy(key, "session", batch.alias("batch")).agg(F.count("*").alias("n_events"), F.min(order).alias("first_id"))


def beliefs(facts: DataFrame, episodes: DataFrame) -> DataFrame:
    """Active facts whose source episodes voice a belief: ``uuid`` and the first such episode."""
    voiced = episodes.where(T.looks_like_belief(F.col("content"))).select(F.col("uuid").alias("episode"))
    rows = facts.where("status = 'active'").select("uuid", F.explode("episodes").alias("episode"))
    return rows.join(voiced, "episode").groupBy("uuid").agg(F.min("episode").alias("episode"))


def goals(episodes: DataFrame) -> DataFrame:
    """Goals that episodes tell, with a short name and the fallback's confidence."""
    told = episodes.select("uuid", "group_id", F.explode(T.goal_clauses(F.col("content"))).alias("goal"))
    return told.select("uuid", "group_id", "goal", T.snake_case(F.left("goal", F.lit(48))).alias("name"), F.lit(0.55).alias("confidence"))


def community_domains(members: DataFrame, facts: DataFrame, most: int = 3) -> DataFrame:
    """The most frequent words of a community's facts: ``group_id, community, domain``."""
    rows = facts.select("group_id", F.col("subj").alias("node"), F.col("created_at").alias("at"), F.col("uuid").alias("id"), F.col("fact").alias("text")).join(members, ["group_id", "node"])
    top = term_ranks(rows, ["group_id", "community"], most)
    return top.groupBy("group_id", "community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]), " ").alias("domain"))


def recall_reinforcement(facts: DataFrame, recalled: DataFrame, now: Column, amount: float = 1.0) -> DataFrame:
    """Rows to write after a recall of ``recalled`` (``uuid``): one more recall, a small activation event at ``now``."""
    hit = facts.join(recalled.select("uuid").distinct(), "uuid", "left_semi")
    return hit.select("uuid", (F.col("recall_count") + 1).alias("recall_count"), now.alias("last_recalled_at"), F.lit(amount * D.RECALL_WEIGHT).alias("event_weight"))
