"""Continuous periods and gaps of half-open intervals per key.

The aggregate state is a sorted list of disjoint intervals, each with a mark that tells whether more than
one distinct interval went into it. Two states combine by a linear merge. The reduction tree has three
levels, and none of them holds all rows of a key in one task:

1. every Arrow batch of the input is reduced to partial lists (map side, no shuffle);
2. the partial lists are range-partitioned by (key, start), so a key with a third of all rows is spread
   over many tasks; each task streams its sorted rows once and keeps one open interval;
3. keys cut by a partition border are stitched: at most two summary rows per partition give each partition
   the largest end before it, which says what the border absorbs.

The lists are kept as rows, never as one array per key, so their length has no bound in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.plans.scratch import Scratch
from chronoweave.sources.tables import micros

OPEN_START, OPEN_END = -(2**63), 2**63 - 1
_NULL = "\x00"  # stands for a null key part between the scan and the result

_LIST = "k1 string, k2 string, s long, e long, multi boolean"
_BLOCK = "pid int, k1 string, k2 string, idx long, s long, e long, multi boolean, prev_e long, edge boolean"


def merge_sorted(k: np.ndarray, s: np.ndarray, e: np.ndarray, multi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linear merge of intervals sorted by (key number, start).

    Returns the first row of each merged interval, its end and its mark. Touching intervals join; equal
    ones count once, so a merged interval is marked unless all its parts are the same unmarked interval.
    """
    n = len(k)
    reach = pd.Series(e).groupby(k, sort=False).cummax().to_numpy()
    new = np.ones(n, bool)
    new[1:] = (k[1:] != k[:-1]) | (s[1:] > reach[:-1])
    first = np.flatnonzero(new)
    ends = np.maximum.reduceat(e, first) if n else e
    block = np.cumsum(new) - 1
    other = multi | (s != s[first][block]) | (e != e[first][block])
    return first, ends, np.logical_or.reduceat(other, first) if n else multi


def _sorted(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    pdf = pdf.sort_values(["k1", "k2", "s", "e"], ignore_index=True)
    return pdf, _numbers(pdf)


def _numbers(pdf: pd.DataFrame) -> np.ndarray:
    k1, k2 = pdf["k1"].to_numpy(object), pdf["k2"].to_numpy(object)
    new = np.ones(len(pdf), bool)
    new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    return np.cumsum(new)


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            pdf, k = _sorted(pdf)
            first, ends, multi = merge_sorted(k, pdf["s"].to_numpy(), pdf["e"].to_numpy(), np.zeros(len(pdf), bool))
            yield pdf.iloc[first].assign(e=ends, multi=multi)[["k1", "k2", "s", "e", "multi"]]


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merge one sorted partition; rows with ``edge`` summarise its first and last key."""
    pid = TaskContext.get().partitionId()
    tail: pd.DataFrame | None = None  # the open interval
    idx, prev_e, first_key, edges = 0, None, None, {}

    def close(out: pd.DataFrame, idx0: int, prev: int | None) -> tuple[pd.DataFrame, int, int | None]:
        """Numbers and previous ends of finished intervals; idx0 and prev continue the key of the first."""
        k = _numbers(out)
        pos = np.arange(len(out)) - np.r_[0, np.flatnonzero(np.diff(k)) + 1][k - 1]
        pos = pos + np.where(k == 1, idx0, 0)
        before = pd.array([prev, *out["e"].iloc[:-1]], dtype="Int64")
        before[pos == 0] = pd.NA
        out = out.assign(pid=pid, idx=pos, prev_e=before, edge=False)
        return out, int(pos[-1]) + 1, int(out["e"].iloc[-1])

    last = None
    for pdf in batches:
        if not len(pdf):
            continue
        if tail is not None:
            pdf = pd.concat([tail, pdf], ignore_index=True)
        k = _numbers(pdf)
        first, ends, multi = merge_sorted(k, pdf["s"].to_numpy(), pdf["e"].to_numpy(), pdf["multi"].to_numpy(bool))
        lists = pdf.iloc[first].assign(e=ends, multi=multi)
        tail, done = lists.iloc[-1:], lists.iloc[:-1]
        for part in (done,):
            if len(part):
                key0 = (part["k1"].iloc[0], part["k2"].iloc[0])
                if key0 != last:
                    idx, prev_e = 0, None
                part, idx, prev_e = close(part, idx, prev_e)
                last = (part["k1"].iloc[-1], part["k2"].iloc[-1])
                if first_key is None:
                    first_key = key0
                own = part[(part["k1"] == first_key[0]) & (part["k2"] == first_key[1])]
                if len(own):
                    edges[first_key] = int(own["e"].max())
                yield part[["pid", "k1", "k2", "idx", "s", "e", "multi", "prev_e", "edge"]]
    if tail is not None:
        key = (tail["k1"].iloc[0], tail["k2"].iloc[0])
        if key != last:
            idx, prev_e = 0, None
        tail, _, _ = close(tail, idx, prev_e)
        edges[key] = int(tail["e"].iloc[0])
        yield tail[["pid", "k1", "k2", "idx", "s", "e", "multi", "prev_e", "edge"]]
        yield pd.DataFrame([(pid, a, b, -1, 0, e, False, None, True) for (a, b), e in edges.items()], columns=["pid", "k1", "k2", "idx", "s", "e", "multi", "prev_e", "edge"]).astype({"prev_e": "Int64"})


def periods_and_gaps(df: DataFrame, key1: str, key2: str, start: str, end: str) -> DataFrame:
    """Merged periods and the gaps between them, per (key1, key2).

    Result: ``kind`` (``period`` or ``gap``), ``key1``, ``key2``, ``start_us``, ``end_us`` (microseconds since
    1970; null for an open side) and ``merged`` (true for a period made of two or more different intervals).

    A null start is open to the past, a null end to the future; intervals whose end is not after their
    start are ignored; equal intervals and repeated rows count once; touching intervals continue each
    other. A null key part is a key of its own. An empty table gives no rows. Other columns are not read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "intervals")
    rows = df.select(
        F.coalesce(F.col(key1).cast("string"), F.lit(_NULL)).alias("k1"),
        F.coalesce(F.col(key2).cast("string"), F.lit(_NULL)).alias("k2"),
        F.coalesce(micros(F.col(start)), F.lit(OPEN_START)).alias("s"),
        F.coalesce(micros(F.col(end)), F.lit(OPEN_END)).alias("e"),
    ).where("e > s")
    partial = scratch.save(rows.mapInPandas(_partial, _LIST))
    ordered = partial.repartitionByRange("k1", "k2", "s").sortWithinPartitions("k1", "k2", "s", "e")
    blocks = scratch.save(ordered.mapInPandas(_stream, _BLOCK))
    scratch.drop(partial)

    # Keys cut by a border: at most two summaries a partition, so this side is bounded by their number.
    at = Window.partitionBy("k1", "k2").orderBy("pid")
    cut = (
        blocks.where("edge").select("pid", "k1", "k2", F.max("e").over(at.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"), F.count("*").over(Window.partitionBy("k1", "k2")).alias("parts"))
        .where("parts > 1").drop("parts")
    )
    body = blocks.where("not edge")
    whole = body.join(cut.select("k1", "k2").distinct(), ["k1", "k2"], "left_anti")
    split = body.join(cut, ["pid", "k1", "k2"]).withColumn("absorbed", F.coalesce(F.col("s") <= F.col("carry"), F.lit(False)).cast("long"))
    sizes = split.groupBy("pid", "k1", "k2").agg(F.sum("absorbed").alias("gone"), F.count("*").alias("n"))
    before = sizes.select("pid", "k1", "k2", "gone", F.coalesce(F.sum(F.col("n") - F.col("gone")).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    numbered = split.join(before, ["pid", "k1", "k2"]).select("k1", "k2", "s", "e", "multi", F.when(F.col("absorbed") == 1, F.col("off") - 1).otherwise(F.col("off") + F.col("idx") - F.col("gone")).alias("no"))
    joined = numbered.groupBy("k1", "k2", "no").agg(
        F.min("s").alias("s"), F.max("e").alias("e"),
        (F.max("multi") | (F.min("s") != F.max("s")) | (F.min("e") != F.max("e"))).alias("multi"),
    )
    later = joined.select("k1", "k2", (F.col("no") - 1).alias("no"), F.col("s").alias("next_s"))
    parts = [
        whole.select(F.lit("period").alias("kind"), "k1", "k2", "s", "e", "multi"),
        whole.where("prev_e is not null").select(F.lit("gap"), "k1", "k2", F.col("prev_e"), F.col("s"), F.lit(False)),
        joined.select(F.lit("period"), "k1", "k2", "s", "e", "multi"),
        joined.join(later, ["k1", "k2", "no"]).select(F.lit("gap"), "k1", "k2", F.col("e"), F.col("next_s"), F.lit(False)),
    ]
    out = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return out.select(
        "kind",
        F.when(F.col("k1") != _NULL, F.col("k1")).alias("key1"),
        F.when(F.col("k2") != _NULL, F.col("k2")).alias("key2"),
        F.when(F.col("s") != OPEN_START, F.col("s")).alias("start_us"),
        F.when(F.col("e") != OPEN_END, F.col("e")).alias("end_us"),
        F.col("multi").alias("merged"),
    )
