"""The offline extractor: entities are capitalised phrases, facts are phrases around a known verb."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.text import all_of

#: Word borders count ASCII letters only.
PHRASE = r"(?<![A-Za-z0-9_])[A-Z][a-z0-9]+(?: [A-Z][a-z0-9]+)*(?![A-Za-z0-9_])"
#: Verbs the extractor knows, and their relations.
VERBS = {"works at": "works_at", "lives in": "lives_in", "moved to": "lives_in", "knows": "knows", "met": "knows", "owns": "owns", "manages": "manages", "likes": "prefers", "prefers": "prefers", "joined": "member_of"}


def phrases(text: Column) -> Column:
    """Distinct capitalised phrases in order."""
    return F.array_distinct(all_of(text, PHRASE))


def facts(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """``subject, predicate, object_name`` of the sentences with a known verb between two phrases."""
    verb = "|".join(VERBS)
    pattern = rf"({PHRASE}) ({verb}) ({PHRASE})"
    found = df.select(*keep, F.explode(F.arrays_zip(*[all_of(F.col(text), pattern, g).alias(f"g{g}") for g in (1, 2, 3)])).alias("m"))
    names = F.create_map(*[F.lit(x) for kv in VERBS.items() for x in kv])
    return found.select(*keep, F.col("m.g1").alias("subject"), F.element_at(names, F.col("m.g2")).alias("predicate"), F.col("m.g3").alias("object_name"))
