"""Filling containers of fixed capacity with texts, by best two fit.

A container is filled greedily with the largest text that fits. When nothing fits any more, its smallest text
is put back if two unpacked texts fill the widened gap more tightly; the best such pair is taken. Texts
longer than the capacity, and no others, are split into full containers and a rest.

Texts are dealt to shards by a hash of their id, each shard is packed on its own. A shard has about
``shard_rows`` texts, so one not quite full container a shard is all that sharding costs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.tokens import VOCABULARY, token_counts
from chronoweave.plans.scratch import Scratch

SHARD_ROWS = 20_000


class Pool:
    """Unpacked items by size. Sizes present are bits of a number, so the questions below are word operations."""

    def __init__(self, sizes: list[int], top: int):
        self.top, self.mask, self.mirror = top, 0, 0
        self.items: dict[int, list[int]] = {}
        for i in range(len(sizes) - 1, -1, -1):
            self.put(sizes[i], i)

    def put(self, size: int, item: int) -> None:
        have = self.items.setdefault(size, [])
        have.append(item)
        if len(have) == 1:
            self.mask |= 1 << size
            self.mirror |= 1 << (self.top - size)

    def take(self, size: int) -> int:
        have = self.items[size]
        item = have.pop()
        if not have:
            self.mask ^= 1 << size
            self.mirror ^= 1 << (self.top - size)
        return item

    def largest(self, most: int) -> int:
        """The largest size up to ``most``, 0 if there is none."""
        return max(0, (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1) if most > 0 else 0

    def pair(self, total: int) -> tuple[int, int] | None:
        """Two sizes that sum to ``total``, the larger first."""
        fits = self.mask & (self.mirror >> (self.top - total)) & ~1
        while fits:
            a = fits.bit_length() - 1
            if a < total - a:
                return None
            if a != total - a or len(self.items[a]) > 1:
                return a, total - a
            fits ^= 1 << a
        return None


def pack(sizes: list[int], capacity: int, separator: int) -> list[list[int]]:
    """Item numbers of each container; every size must be from 1 to ``capacity``."""
    top = capacity + separator  # each text brings one separator along, the container has room for one more
    pool, out = Pool([s + separator for s in sizes], top), []
    while pool.mask:
        packed: list[tuple[int, int]] = []
        gap = top
        while size := pool.largest(gap):
            packed.append((size, pool.take(size)))
            gap -= size
        while gap and pool.mask and len(packed) > 1:
            small = min(packed)
            wide = gap + small[0]
            found = next((p for t in range(wide, small[0], -1) if (p := pool.pair(t))), None)
            if not found:
                break
            packed.remove(small)
            packed += [(size, pool.take(size)) for size in found]
            pool.put(*small)
            gap = wide - sum(found)
        out.append([item for _, item in packed])
    return out


_PACKED = "spec_id long, container_id long, position int, doc_id {}, part int, token_start long, token_end long"


def pack_documents(documents: DataFrame, specs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per text and part: ``spec_id, container_id, position, doc_id, part, token_start, token_end``.

    ``specs`` (``spec_id``, ``capacity_tokens``, ``separator_tokens``) is a small table of settings. Separators stand
    between two texts of a container and count towards the capacity. Null and empty texts take no room and
    have no row; rows repeating an id are one text; specs with a null or without capacity are left out; no
    texts or no specs give no rows. The order of rows of one size is that of their ids.
    """
    spark = documents.sparkSession
    wanted = sorted({(r.spec_id, r.capacity_tokens, r.separator_tokens or 0) for r in specs.collect() if r.spec_id is not None and r.capacity_tokens and r.capacity_tokens > 0})
    sized = Scratch(spark, "packing").save(token_counts(documents, id_col, text_col, path=vocabulary).where("n_tokens > 0"))
    shards = max(1, -(-sized.count() // shard_rows))
    once = sized.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))
    dealt = once.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))

    def run(key: tuple, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        pdf = pdf.sort_values("doc_id")
        ids, sizes = pdf["doc_id"].tolist(), pdf["n_tokens"].tolist()
        for spec, capacity, separator in wanted:
            base = int(key[0]) << 40
            out, items = [], []  # items: (document, part, from, to) that share containers
            for d, n in enumerate(sizes):
                full = n // capacity if n > capacity else 0
                for part in range(full):
                    out.append((spec, base, 0, ids[d], part, part * capacity, (part + 1) * capacity))
                    base += 1
                if n > full * capacity:
                    items.append((d, full, full * capacity, n))
            for container in pack([to - at for _, _, at, to in items], capacity, separator):
                out += [(spec, base, place, ids[items[i][0]], *items[i][1:]) for place, i in enumerate(container)]
                base += 1
            yield pd.DataFrame(out, columns=["spec_id", "container_id", "position", "doc_id", "part", "token_start", "token_end"])

    return dealt.groupBy("shard").applyInPandas(lambda key, pdf: pd.concat(list(run(key, pdf)) or [pd.DataFrame(columns=["spec_id", "container_id", "position", "doc_id", "part", "token_start", "token_end"])]), _PACKED.format(sized.schema["doc_id"].dataType.simpleString()))


def fill_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Containers, tokens and the share of the capacity that is used, per spec."""
    each = packed.groupBy("spec_id", "container_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("used"), F.count("*").alias("n"))
    room = each.join(specs, "spec_id").withColumn("used_all", F.col("used") + (F.col("n") - 1) * F.col("separator_tokens"))
    return room.groupBy("spec_id").agg(
        F.count("*").alias("n_containers"), F.sum("n").alias("n_texts"), F.sum("used").alias("n_tokens"),
        (F.sum("used_all") / F.sum("capacity_tokens")).alias("fill"), F.max(F.col("used_all") - F.col("capacity_tokens")).alias("most_over"),
    )
