"""Steps that a model may take over: small interfaces with deterministic offline defaults."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import extract
from chronoweave.functions.text import telling_words
from chronoweave.functions.vectors import dummy_embedding


class Extractor(Protocol):
    def facts(self, episodes: DataFrame, text: str, *keep: str) -> DataFrame: ...


class Embedder(Protocol):
    def embed(self, df: DataFrame, text: str, into: str) -> DataFrame: ...


class Judge(Protocol):
    def contradicts(self, pairs: DataFrame) -> DataFrame: ...


class OfflineExtractor:
    def facts(self, episodes: DataFrame, text: str, *keep: str) -> DataFrame:
        return extract.facts(episodes, text, *keep)


class OfflineEmbedder:
    """Hashed bags of words; rows that have a vector keep it."""

    def embed(self, df: DataFrame, text: str, into: str) -> DataFrame:
        made = dummy_embedding(F.col(text))
        return df.withColumn(into, F.coalesce(into, made) if into in df.columns else made)


class OfflineJudge:
    """A new text ends an old fact if it tells of a change and shares two telling words with it (``new, old``)."""

    CUES = r"(?i)\b(?:no longer|not any ?more|moved|left|quit|stopped|instead|used to|switched)\b"

    def contradicts(self, pairs: DataFrame) -> DataFrame:
        shared = F.size(F.array_intersect(telling_words(F.col("new")), telling_words(F.col("old"))))
        return pairs.where(F.col("new").rlike(self.CUES) & (shared >= 2))
