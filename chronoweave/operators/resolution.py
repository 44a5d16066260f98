"""Resolution of extracted names and predicates to entities and relation frames, and fact repair."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.functions.text import normalize_alias

#: Predicates that name their subject, fillers of places, and predicates of places.
IDENTITY = ("is_named", "is_called", "is_self", "is_aka", "mentions_with")
FILLERS = ("world", "earth", "universe", "everywhere", "anywhere", "somewhere")
PLACES = ("lives_in", "located_in", "from", "resides_in", "based_in")
DECLARED = ("is_named", "is_called", "is_aka", "has_alias", "also_known_as")
#: The frames every graph has: (name, aliases, direction, inverse name, kind, cardinality, policy, confidence).
DEFAULT_FRAMES = (
    ("spouse_of", ("wife_of", "husband_of", "married_to", "partner_of"), "symmetric", None, "state", "one_current", "replace", 0.9),
    ("parent_of", ("father_of", "mother_of", "mom_of", "dad_of"), "inverse_pair", "child_of", "timeless", "many_current", "coexist", 0.9),
    ("child_of", ("son_of", "daughter_of"), "inverse_pair", "parent_of", "timeless", "many_current", "coexist", 0.9),
    ("sibling_of", ("brother_of", "sister_of"), "symmetric", None, "timeless", "many_current", "coexist", 0.9),
    ("friend_of", ("friends_with",), "symmetric", None, "state", "many_current", "coexist", 0.7),
    ("lives_in", ("resides_in", "based_in", "located_in", "from"), "directed", None, "state", "one_current", "replace", 0.85),
    ("works_at", ("employed_by", "employee_of", "works_for"), "directed", None, "state", "one_current", "replace", 0.85),
    ("member_of", ("belongs_to", "part_of"), "directed", None, "state", "many_current", "coexist", 0.7),
    ("owns", ("has", "possesses"), "directed", None, "state", "many_current", "coexist", 0.7),
    ("owns_pet", ("has_pet", "owns_dog", "owns_cat", "pet_is"), "directed", None, "state", "many_current", "coexist", 0.8),
    ("is_named", ("is_called", "is_aka", "name_is", "goes_by"), "directed", None, "state", "many_current", "coexist", 0.95),
    ("born_in", ("was_born_in", "birthplace_is"), "directed", None, "timeless", "one_current", "replace", 0.95),
    ("located_in", ("situated_in", "found_in"), "directed", None, "state", "one_current", "replace", 0.7),
    ("contains", ("includes", "holds"), "inverse_pair", "part_of", "state", "many_current", "coexist", 0.7),
    ("precedes", ("before", "happens_before"), "inverse_pair", "follows", "event", "many_historical", "coexist", 0.7),
)


def default_frames(spark: SparkSession) -> DataFrame:
    rows = [(n, list(al), *rest) for n, al, *rest in DEFAULT_FRAMES]
    return spark.createDataFrame(rows, "canonical string, aliases array<string>, direction string, inverse_name string, temporal_kind string, cardinality string, policy string, confidence double")


def resolve_frames(predicates: DataFrame, frames: DataFrame) -> DataFrame:
    """``group_id, predicate`` with the frame's name: the group's own before the global one, names before aliases."""
    keys = frames.select(F.coalesce("group_id", F.lit("")).alias("fg"), "canonical_name", "cardinality", F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("k"))
    keys = keys.select("fg", "canonical_name", "cardinality", F.lower(F.trim("k")).alias("predicate"), (F.lower(F.trim("k")) != F.lower("canonical_name")).cast("int").alias("by_alias"))
    j = predicates.join(keys, "predicate", "left").where("fg is null or fg = '' or fg = group_id")
    at = Window.partitionBy("group_id", "predicate").orderBy((F.col("fg") == "").cast("int"), "by_alias", "canonical_name")
    return j.withColumn("_n", F.row_number().over(at)).where("_n = 1").select("group_id", "predicate", F.coalesce("canonical_name", "predicate").alias("canonical"), F.coalesce("cardinality", F.lit("unknown")).alias("cardinality"))


def repair(facts: DataFrame, speaker: Column) -> DataFrame:
    """Extracted facts without empty parts, place fillers and self loops; an identity fact about oneself is the speaker's."""
    loop = F.lower("subject") == F.lower("object_name")
    identity = F.col("predicate").isin(*IDENTITY)
    kept = facts.where("subject != '' and predicate != '' and object_name != ''").where(~(F.col("predicate").isin(*PLACES) & F.lower("object_name").isin(*FILLERS)))
    kept = kept.where(~loop | (identity & speaker.isNotNull()))
    return kept.withColumn("subject", F.when(loop & identity, speaker).otherwise(F.col("subject")))


def singleton_decision(operation: Column, cardinality: Column, flag: Column, from_user: Column, policy: Column | None = None) -> Column:
    """Whether an assertion closes its slot.

    ``cardinality`` is null where the relation has no frame; only then does the extractor's ``flag`` count, and only for what
    the user said. A frame of one current value closes unless its ``policy`` is ``uncertain``; a qualification never does, a
    user's correction always.
    """
    framed = cardinality.isNotNull()
    unsure = F.coalesce(policy == "uncertain", F.lit(False)) if policy is not None else F.lit(False)
    by_frame = framed & F.coalesce(cardinality.isin("one", "one_current"), F.lit(False)) & ~unsure
    return ((operation != "qualify") & (by_frame | (~framed & flag & from_user))) | ((operation == "correct") & from_user)


def resolve_names(mentions: DataFrame, aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """``group_id, mention`` with ``entity_uuid`` and ``how``: ``alias_hit``, ``exact_name`` or ``new``.

    An alias counts only if its entity exists in the group; the most confident alias wins, then the smallest
    uuid. Of several entities with one name the first by uuid wins.
    """
    keyed = mentions.withColumn("key", normalize_alias(F.col("mention")))
    known = entities.select("group_id", F.col("uuid").alias("entity_uuid"), normalize_alias(F.col("name")).alias("key"))
    told = aliases.where("entity_uuid is not null").select("group_id", normalize_alias(F.coalesce("normalized_alias", "alias")).alias("key"), "entity_uuid", "confidence").join(known.select("group_id", "entity_uuid"), ["group_id", "entity_uuid"], "left_semi")
    pick = Window.partitionBy("group_id", "key").orderBy(F.desc("confidence"), "entity_uuid")
    by_alias = told.withColumn("_n", F.row_number().over(pick)).where("_n = 1").select("group_id", "key", F.col("entity_uuid").alias("by_alias"))
    by_name = known.groupBy("group_id", "key").agg(F.min("entity_uuid").alias("by_name"))
    j = keyed.join(by_alias, ["group_id", "key"], "left").join(by_name, ["group_id", "key"], "left")
    return j.select("group_id", "mention", F.coalesce("by_alias", "by_name").alias("entity_uuid"), F.when(F.col("by_alias").isNotNull(), "alias_hit").when(F.col("by_name").isNotNull(), "exact_name").otherwise("new").alias("how"))


def numbers_in(text: Column) -> Column:
    return F.array_join(F.array_sort(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0))), ",")


def _padded(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of doubles, filled up with zeros, and their lengths. One with a null element is zero, as is its cosine."""
    lists = pa.concat_arrays(col.chunks)
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten()
    row = np.repeat(np.arange(len(size)), size)
    out = np.zeros((len(size), max(1, size.max(initial=0))))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = values.to_numpy(zero_copy_only=False)
    if values.null_count:
        out[row[values.is_null().to_numpy(zero_copy_only=False)]] = 0.0
    return out, size


def _total(x: np.ndarray) -> np.ndarray:
    """Sums of rows from left to right, as ``vectors.dot`` adds."""
    return np.cumsum(x, axis=1)[:, -1]


def _round6(x: np.ndarray) -> np.ndarray:
    """``F.round(x, 6)``, halves of the shortest decimal away from zero."""
    scaled = np.abs(x) * 1e6
    out = np.copysign(np.floor(scaled + 0.5) / 1e6, x)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


def _two_largest(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Places of the two largest values of each row, of equal ones the first; NaN is larger than any number."""
    order = np.lexsort((np.arange(len(row)), np.where(np.isnan(value), -np.inf, -value), row))
    held = np.bincount(row, minlength=n)
    return order[np.arange(len(row)) - np.repeat(np.cumsum(held) - held, held) < 2]


def _best_two(v: np.ndarray, size: np.ndarray, code: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of ``left`` with the two most similar rows of ``right`` of their code, by score and then by place.

    Both are places of ``v`` in the order of codes. A matrix product tells which pairs can count; their score is computed
    as the plan of built-in functions would, so no result hangs on the product's rounding.
    """
    with np.errstate(all="ignore"):
        norm = np.sqrt(_total(v * v))
        unit = v / np.where(norm > 0, norm, 1.0)[:, None]
        unit[~np.isfinite(norm)] = np.nan  # all their pairs are scored
        floor = threshold - 1e-6
        # Of equal vectors of a code the first two can be among the best two.
        _, same = np.unique(np.column_stack([code[right], size[right], v[right].view(np.int64)]), axis=0, return_inverse=True)
        right = right[np.sort(_two_largest(same.ravel(), np.zeros(len(right)), len(right)))]
        codes = code[right]
        for at in range(0, len(left), 256):
            mine = left[at : at + 256]
            lo, hi = np.searchsorted(codes, code[mine[0]], "left"), np.searchsorted(codes, code[mine[-1]], "right")
            near = unit[mine] @ unit[right[lo:hi]].T
            i, j = np.nonzero(~(near < floor)) if floor > 0 else np.indices(near.shape).reshape(2, -1)
            alike = code[mine[i]] == codes[lo + j]
            i, j = i[alike], j[alike]
            about = np.where(size[mine[i]] == size[right[lo + j]], near[i, j], 0.0)
            # Pairs clearly below a row's second are not among its best two, nor are NaNs a measure of it.
            sure = np.flatnonzero(~np.isnan(about))
            two = sure[_two_largest(i[sure], about[sure], len(mine))]
            second = np.full(len(mine), np.inf)
            np.minimum.at(second, i[two], about[two])
            second[np.bincount(i[two], minlength=len(mine)) < 2] = -np.inf
            worth = np.isnan(about) | (about >= second[i] - 2e-6)
            a, b = mine[i[worth]], right[lo + j[worth]]
            score = np.empty(len(a))
            for s in range(0, len(a), 65536):
                x, y = a[s : s + 65536], b[s : s + 65536]
                cos = _total(v[x] * v[y]) / (norm[x] * norm[y])
                score[s : s + 65536] = np.where((size[x] != size[y]) | (norm[x] <= 0) | (norm[y] <= 0), 0.0, cos)
            score = _round6(score)
            kept = ~(score < threshold)
            a, b, score = a[kept], b[kept], score[kept]
            best = _two_largest(a - mine[0], score, int(mine[-1] - mine[0]) + 1)
            yield a[best], b[best], score[best]


def _compare(keys: list[str], threshold: float, rows: int):
    """Streams rows in the order of ``keys``, mentions before entities and these by id; whole keys are compared at a time."""

    def scored(table: pa.Table, code: np.ndarray) -> Iterator[pa.RecordBatch]:
        v, size = _padded(table["vector"])
        asks = table["asks"].to_numpy()
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
        if len(left) and len(right):
            for a, b, score in _best_two(v, size, code, left, right, threshold):
                out = table.select(["group_id", "mention"]).take(a).append_column("entity_uuid", table["entity_uuid"].take(b)).append_column("score", pa.array(score))
                yield from out.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        waiting = 0

        def codes(table: pa.Table) -> np.ndarray:
            new = np.zeros(len(table), bool)
            for k in keys:
                new[1:] |= pc.not_equal(table[k][1:].combine_chunks(), table[k][:-1].combine_chunks()).to_numpy(zero_copy_only=False)
            return np.cumsum(new)

        for batch in batches:
            held.append(batch)
            waiting += batch.num_rows
            if waiting >= rows:
                table = pa.Table.from_batches(held).combine_chunks()
                code = codes(table)
                whole = int(np.searchsorted(code, code[-1]))  # the last key may go on
                if whole:
                    yield from scored(table[:whole], code[:whole])
                held, waiting = table[whole:].to_batches(), 0
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            if len(table):
                yield from scored(table, codes(table))

    return run


def resolve_semantic(mentions: DataFrame, entities: DataFrame, threshold: float = 0.86, margin: float = 0.05, block: int = 8192) -> DataFrame:
    """The most similar entity of each mention (``group_id, mention, vector``) by name vector, and whether it is clear.

    Only entities of the group with the same numbers in their name are compared, so rows meet by (group, numbers). A match is
    clear if it is the only one or leads by ``margin``.

    Every pair of such a key is compared, by matrix products over many rows at a time. A key with more than ``block`` mentions
    or entities is cut on both sides into parts of about ``block`` rows; each two parts meet in one place, from which a mention
    brings its best two.
    """
    keys = ["group_id", "numbers"]
    left = mentions.where("vector is not null").select("group_id", "mention", "vector", numbers_in(F.col("mention")).alias("numbers"))
    right = entities.where("name_embedding is not null").select("group_id", F.col("uuid").alias("entity_uuid"), F.col("name_embedding").alias("vector"), numbers_in(F.col("name")).alias("numbers"))
    rows = left.withColumn("asks", F.lit(True)).unionByName(right.withColumn("asks", F.lit(False)), allowMissingColumns=True).where("group_id is not null and numbers is not null")
    asks = F.col("asks").cast("int")
    cuts = rows.groupBy(*keys).agg(F.ceil(F.sum(asks) / block).alias("lefts"), F.ceil(F.sum(1 - asks) / block).alias("rights")).where("lefts > 1 or rights > 1")
    j = rows.join(cuts, keys, "left").withColumn("lefts", F.greatest(F.coalesce("lefts", F.lit(1)), F.lit(1))).withColumn("rights", F.greatest(F.coalesce("rights", F.lit(1)), F.lit(1)))
    one = lambda c, n: F.array(F.pmod(F.xxhash64(c), F.col(n)))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    j = j.withColumn("i", F.explode(F.when(F.col("asks"), one("mention", "lefts")).otherwise(every("lefts")))).withColumn("j", F.explode(F.when(F.col("asks"), every("rights")).otherwise(one("entity_uuid", "rights"))))
    at = [*keys, "i", "j"]
    met = j.select(*at, "asks", "mention", "entity_uuid", "vector").repartition(*at).sortWithinPartitions(*at, F.desc("asks"), "entity_uuid")
    kind = {f.name: f.dataType.simpleString() for f in met.schema}
    scored = met.mapInArrow(_compare(at, threshold, block), f"group_id {kind['group_id']}, mention {kind['mention']}, entity_uuid {kind['entity_uuid']}, score double")
    by = Window.partitionBy("group_id", "mention").orderBy(F.desc("score"), "entity_uuid")
    ranked = scored.withColumn("_n", F.row_number().over(by)).withColumn("_next", F.lead("score").over(by)).where("_n = 1")
    return ranked.select("group_id", "mention", "entity_uuid", "score", (F.col("_next").isNull() | (F.round(F.col("score") - F.col("_next"), 6) >= margin)).alias("clear"))


def case_merge(entities: DataFrame) -> DataFrame:
    """Entities that differ only in case and blanks from an older one: ``uuid`` to ``kept_uuid``."""
    key = F.lower(F.trim(F.regexp_replace("name", r"\s+", " ")))
    at = Window.partitionBy("group_id", key).orderBy("created_at", "uuid")
    return entities.withColumn("kept_uuid", F.first("uuid").over(at)).where("uuid != kept_uuid").select("uuid", "kept_uuid")


def declared_aliases(facts: DataFrame) -> DataFrame:
    """Names that users declare, with how many subjects claim each."""
    said = facts.where(F.col("predicate").isin(*DECLARED) & (F.col("operation") == "assert")).select("group_id", normalize_alias(F.col("object_name")).alias("alias"), "subject").distinct()
    return said.groupBy("group_id", "alias").agg(F.count("*").alias("n_subjects"))


def allowed_by_types(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Facts whose endpoint types (``subj_type``, ``obj_type``) have a rule; a rule with an empty list allows any predicate."""
    r = rules.select("subj_type", "obj_type", "predicates")
    return facts.join(r, ["subj_type", "obj_type"]).where((F.size("predicates") == 0) | F.array_contains("predicates", F.col("pred"))).drop("predicates")


def register_frames(frames: DataFrame, new: DataFrame) -> DataFrame:
    """Frames with new ones over those of the same group and name; all columns of ``frames`` stay, those ``new`` lacks are null."""
    kept = frames.join(new.select("group_id", "canonical_name"), ["group_id", "canonical_name"], "left_anti").select(*frames.columns)
    fresh = new.dropDuplicates(["group_id", "canonical_name"])
    return kept.unionByName(fresh.select(*[F.col(f.name) if f.name in fresh.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in frames.schema]))


def merge_frames(frames: DataFrame, into: str, other: str) -> DataFrame:
    """One frame made an alias of another: names and aliases of both end up with ``into``."""
    empty = F.array().cast("array<string>")
    moved = frames.where(F.col("canonical_name").isin(into, other)).groupBy("group_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("canonical_name"), F.coalesce("aliases", empty)))))).alias("aliases"))
    merged = moved.select("group_id", F.lit(into).alias("canonical_name"), F.filter("aliases", lambda a: a != into).alias("aliases"))
    return frames.where(~F.col("canonical_name").isin(into, other)).select("group_id", "canonical_name", "aliases").unionByName(merged)


def replace_targets(facts: DataFrame, similar: DataFrame, subj: str) -> DataFrame:
    """Open, active facts of a subject among similar ones: those an explicit replacement ends."""
    return facts.where((F.col("subj") == subj) & (F.col("status") == "active") & F.col("invalid_at").isNull()).join(similar.select("uuid"), "uuid", "left_semi").select("uuid")
