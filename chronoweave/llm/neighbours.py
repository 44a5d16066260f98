"""The most similar vectors of every vector, by an inverted multi-index.

The two halves of a vector are quantised separately, so K centroids a half make K x K cells. A query visits
cells by the summed distance of its halves to the cell's two centroids; the queue of that traversal holds
the next cell of each first-half centroid, and popping its minimum yields the cells in order. All vectors of
the visited cells are compared with the query itself, so every returned similarity is exact.

How many cells a query visits is measured: the true neighbours of a bounded sample of queries are found by a scan of all
vectors, and as many cells are visited as it takes to reach ``recall`` of them. Where neighbours stand out these are a
few cells; where all vectors are about equally far, as among random ones, it is a good part of all cells, and no index helps.
A ``recall`` of 1 visits every cell: the exact answer.

Scale: codebooks come from a bounded sample, all vectors are indexed. K grows with the root of the number of vectors, so a
cell keeps its size. Cells are gathered in at most 65,536 blocks, laid out in order and cut into tasks of about ``task_rows``
vectors; a block with more is spread over several tasks and its queries go to each. A task that too many queries visit is
cut by queries, and each cut gets the task's vectors. A query reaches a task once, with the cells it visits there. Equal
vectors are one class during the search: a class keeps its ``k + 1`` smallest ids, which is all that a nearest list of its
members can need.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.plans.scratch import Scratch


@dataclass(frozen=True)
class MultiIndex:
    """``sample``: vectors that train the codebooks, or 32 a centroid if that is more; ``cell_rows``: vectors aimed at per
    cell; ``probes``: least cells that a query visits; ``recall``: part of the true neighbours that the visited cells should
    hold, 1 for all cells; ``checks``: queries by which that is measured; ``task_rows`` and ``task_queries``: vectors and
    queries per search task; ``oversample``: how many times k a task may return."""

    dim: int = 64
    sample: int = 16384
    cell_rows: int = 24
    probes: int = 16
    recall: float = 0.95
    checks: int = 1024
    task_rows: int = 48000
    task_queries: int = 200000
    oversample: int = 4
    rounds: int = 8


#: Blocks of cells along each half.
_SIDE = 256

_USABLE = "id string, asks boolean, h binary, v binary"
_ROUTED = "task int, cut int, h binary, v binary, own int, cells binary"
_FOUND = "q binary, e binary, sim double"


def usable(dim: int):
    """Arrow function: unit vectors of the rows whose vector has ``dim`` finite numbers, not all zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vecs, asks = batch.column(0), batch.column(1), batch.column(2)
            fit = pc.and_(pc.is_valid(ids), pc.fill_null(pc.equal(pc.list_value_length(vecs), dim), False))
            ids, vecs, asks = ids.filter(fit), vecs.filter(fit), asks.filter(fit)
            x = np.asarray(pc.fill_null(vecs.flatten().cast(pa.float64()), float("nan"))).reshape(-1, dim)
            ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            x = x[ok] / np.abs(x[ok]).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            unit = np.ascontiguousarray(x, dtype="<f4")
            # One class for vectors that agree to four decimals once their norm is 1.
            keys = np.ascontiguousarray(np.rint(x * 1e4).astype("<i2"))
            yield pa.RecordBatch.from_arrays([
                ids.filter(pa.array(ok)).cast(pa.string()), asks.filter(pa.array(ok)), pa.array([xxhash.xxh3_128_digest(k) for k in keys], pa.binary()),
                pa.array([u.tobytes() for u in unit], pa.binary()),
            ], names=["id", "asks", "h", "v"])

    return run


def train(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Centroids of Lloyd's algorithm, in the order of their first principal component."""
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype("f4")
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c).astype("f4")
    _, _, axes = np.linalg.svd(c - c.mean(0), full_matrices=False)
    return c[np.argsort(c @ axes[0])]


def visit(d1: np.ndarray, d2: np.ndarray, probes: int) -> np.ndarray:
    """Cells of each query in the order of d1[i] + d2[j], as ``i * columns + j``; at most ``probes``.

    The queue of a query has one slot for each of its nearest first-half centroids: the cell with the next
    second-half centroid in that row. Queries advance together, one pop a step.
    """
    rows, cols = d1.shape[1], d2.shape[1]
    if probes >= rows * cols or (probes > 64 and rows * cols <= 65536):  # most cells of a small grid: one sort does it
        probes = min(probes, rows * cols)
        out = np.empty((len(d1), probes), np.int64)
        for at in range(0, len(d1), step := max(1, 8_000_000 // (rows * cols))):
            total = (d1[at : at + step, :, None] + d2[at : at + step, None, :]).reshape(-1, rows * cols)
            out[at : at + step] = np.argsort(total, axis=1, kind="stable")[:, :probes]
        return out
    m1, m2 = min(rows, probes), min(cols, probes)
    o1, o2 = (np.argpartition(d, m - 1, axis=1)[:, :m] if m < d.shape[1] else np.broadcast_to(np.arange(m), (len(d), m)) for d, m in ((d1, m1), (d2, m2)))
    o1, o2 = (np.take_along_axis(o, np.argsort(np.take_along_axis(d, o, 1), axis=1, kind="stable"), 1) for d, o in ((d1, o1), (d2, o2)))
    s1, s2 = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)
    s2 = np.hstack([s2, np.full((len(s2), 1), np.inf, s2.dtype)])
    n, at = len(d1), np.arange(len(d1))
    nxt = np.zeros((n, m1), np.int64)
    queue = s1 + s2[:, :1]
    out = np.empty((n, min(probes, m1 * m2)), np.int64)
    for step in range(out.shape[1]):
        top = queue.argmin(1)
        j = nxt[at, top]
        out[:, step] = o1[at, top] * cols + o2[at, j]
        nxt[at, top] = j + 1
        queue[at, top] = s1[at, top] + s2[at, j + 1]
    return out


def place(d1: np.ndarray, d2: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """How many cells each query visits before its given cell."""
    out = np.empty(len(d1), np.int64)
    for i, (a, b) in enumerate(zip(d1, d2)):
        total = a[cell[i] // len(b)] + b[cell[i] % len(b)]
        out[i] = np.searchsorted(np.sort(b), total - a, "left").sum()
    return out


def _halves(v: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    half = books[0].shape[1]
    return tuple((c * c).sum(1) - 2 * x @ c.T for x, c in zip((v[:, :half], v[:, half:]), books))


def _vectors(col: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<f4").reshape(-1, dim)


class Grid:
    """Codebooks and how their cells are gathered in blocks."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray]):
        self.books = books
        self.rows, self.cols = len(books[0]), len(books[1])
        self.side = min(self.rows, _SIDE), min(self.cols, _SIDE)

    def block(self, cells: np.ndarray) -> np.ndarray:
        return (cells // self.cols) * self.side[0] // self.rows * self.side[1] + (cells % self.cols) * self.side[1] // self.cols

    def parts(self, n: int) -> Iterator[slice]:
        """Slices of a batch whose distances fit in memory."""
        step = max(64, 8_000_000 // max(self.rows, self.cols))
        return (slice(a, min(n, a + step)) for a in range(0, n, step))


def count_blocks(grid: Grid, probes: int, dim: int):
    """Arrow function: vectors and visiting queries of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(grid.side[0] * grid.side[1], np.int64)
        seen = held.copy()
        for batch in batches:
            v, asks = _vectors(batch.column(0), dim), np.asarray(batch.column(1))
            for at in grid.parts(len(v)):
                d1, d2 = _halves(v[at], grid.books)
                held += np.bincount(grid.block(d1.argmin(1) * grid.cols + d2.argmin(1)), minlength=len(held))
                ask = asks[at]
                if ask.any():
                    blocks = np.sort(grid.block(visit(d1[ask], d2[ask], probes)), axis=1)
                    once = np.hstack([np.ones((len(blocks), 1), bool), blocks[:, 1:] != blocks[:, :-1]])
                    seen += np.bincount(blocks[once], minlength=len(seen))
        at = np.flatnonzero(held + seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(held[at]), pa.array(seen[at])], names=["block", "held", "seen"])

    return run


def route(grid: Grid, first: np.ndarray, last: np.ndarray, cuts: np.ndarray, probes: int, conf: MultiIndex):
    """Arrow function: a vector to the task of its own cell, and as a query to every task it visits."""

    def part(hs: list, vs: pa.Array, asks: np.ndarray) -> Iterator[pa.RecordBatch]:
        d1, d2 = _halves(_vectors(vs, conf.dim), grid.books)
        own = d1.argmin(1) * grid.cols + d2.argmin(1)
        mine = grid.block(own)
        salt = np.array([xxhash.xxh32_intdigest(h) for h in hs], np.int64)
        home = first[mine] + salt % (last[mine] - first[mine] + 1)
        # Each vector once to every cut of its task; if it asks and its task has one cut, its own visit there brings it along.
        alone = np.flatnonzero(~asks | (cuts[home] > 1))
        copies = cuts[home[alone]]
        ei = np.repeat(alone, copies)
        cut_of = np.arange(len(ei)) - np.repeat(np.cumsum(copies) - copies, copies)
        yield pa.RecordBatch.from_arrays([
            pa.array(home[ei].astype("i4")), pa.array(cut_of.astype("i4")), pa.array([hs[i] for i in ei], pa.binary()), vs.take(pa.array(ei)).cast(pa.binary()), pa.array(own[ei].astype("i4")), pa.array([b""] * len(ei), pa.binary()),
        ], names=["task", "cut", "h", "v", "own", "cells"])
        ask = np.flatnonzero(asks)
        if not len(ask):
            return
        cells = visit(d1[ask], d2[ask], probes)
        unseen = ~(cells == own[ask][:, None]).any(axis=1)  # of equally near centroids another one may come first
        cells[unseen, -1] = own[ask][unseen]
        blocks = grid.block(cells)
        # (query, task, cell) of all visits; blocks over several tasks are visited in each.
        width = last[blocks] - first[blocks] + 1
        flat = width.ravel()
        qi = np.repeat(np.repeat(ask, cells.shape[1]), flat)
        cell = np.repeat(cells.ravel(), flat)
        task = np.repeat(first[blocks].ravel(), flat) + np.arange(len(qi)) - np.repeat(np.cumsum(flat) - flat, flat)
        order = np.lexsort((task, qi))
        qi, task, cell = qi[order], task[order].astype(np.int64), cell[order].astype("<i4")
        start = np.flatnonzero(np.r_[True, (qi[1:] != qi[:-1]) | (task[1:] != task[:-1])])
        stops = np.r_[start[1:], len(qi)]
        qs, ts = qi[start], task[start]
        yield pa.RecordBatch.from_arrays([
            pa.array(ts.astype("i4")), pa.array((salt[qs] // 7919 % cuts[ts]).astype("i4")), pa.array([hs[i] for i in qs], pa.binary()), vs.take(pa.array(qs)).cast(pa.binary()),
            pa.array(np.where((ts == home[qs]) & (cuts[ts] == 1), own[qs], -1).astype("i4")), pa.array([cell[a:b].tobytes() for a, b in zip(start, stops)], pa.binary()),
        ], names=["task", "cut", "h", "v", "own", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, vs, asks = batch.column(0).to_pylist(), batch.column(1), np.asarray(batch.column(2))
            step = max(16, min(4096, 2_000_000 // probes, 8_000_000 // max(grid.rows, grid.cols)))
            for a in range(0, len(hs), step):
                yield from part(hs[a : a + step], vs.slice(a, step), asks[a : a + step])

    return run


def scan(queries: np.ndarray, k: int, floor: float | None, dim: int):
    """Arrow function: the ``k`` vectors of a partition most similar to each query, other than the query itself."""
    least = -1.5 if floor is None else floor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            v = _vectors(batch.column(0), dim)
            if not len(v):
                continue
            sim = queries @ v.T
            sim[sim > 1 - 1e-6] = -2  # the query's own class
            m = min(k, len(v))
            top = np.argpartition(-sim, m - 1, axis=1)[:, :m]
            best.append((np.repeat(np.arange(len(queries)), m), v[top.ravel()], np.take_along_axis(sim, top, 1).ravel()))
            if len(best) > 8:
                best = [_top(best, k)]
        if best:
            q, v, sim = _top(best, k)
            keep = sim >= least
            yield pa.RecordBatch.from_arrays([pa.array(q[keep].astype("i4")), pa.array([x.tobytes() for x in v[keep]], pa.binary()), pa.array(sim[keep].astype("f8"))], names=["q", "v", "sim"])

    return run


def _top(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    q, v, sim = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((-sim, q))
    q, v, sim = q[order], v[order], sim[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
    return q[keep], v[keep], sim[keep]


def needed_probes(classes: DataFrame, asking: np.ndarray, grid: Grid, k: int, floor: float | None, everyone: bool, conf: MultiIndex) -> int:
    """Cells that a query has to visit so that ``conf.recall`` of the true neighbours are met, measured on the queries
    ``asking`` against all vectors. If everyone asks, a pair is met from either side."""
    cells = grid.rows * grid.cols
    if conf.recall >= 1:
        return cells
    if not len(asking):
        return min(cells, conf.probes)
    near = classes.select("v").mapInArrow(scan(asking, k, floor, conf.dim), "q int, v binary, sim double")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "v"))).where(F.col("r") <= k).collect()  # at most checks * k rows
    if not near:
        return min(cells, conf.probes)
    e = np.frombuffer(b"".join(bytes(r.v) for r in near), "<f4").reshape(-1, conf.dim)
    q = asking[[r.q for r in near]]
    own = lambda d: d[0].argmin(1) * grid.cols + d[1].argmin(1)
    dq, de = _halves(q, grid.books), _halves(e, grid.books)
    at = place(*dq, own(de))
    if everyone:
        at = np.minimum(at, place(*de, own(dq)))
    return int(min(cells, max(conf.probes, np.quantile(at, conf.recall, method="higher") + 1)))


def compare(k: int, floor: float | None, conf: MultiIndex):
    """Arrow function over one task: similarities of its queries to the vectors of the cells they visit."""
    keep = k * conf.oversample
    least = -1.5 if floor is None else floor

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        v = _vectors(table["v"], conf.dim)
        own = table["own"].to_numpy()
        h = table["h"].combine_chunks()
        h = h.chunk(0) if isinstance(h, pa.ChunkedArray) else h
        code = h.dictionary_encode().indices.to_numpy()
        entries = np.flatnonzero(own >= 0)
        entries = entries[np.argsort(own[entries], kind="stable")]
        cells, start, n = np.unique(own[entries], return_index=True, return_counts=True)
        lengths = pc.binary_length(table["cells"]).to_numpy()
        queries = np.flatnonzero(lengths > 0)
        lists = [np.frombuffer(c, "<i4") for c in table["cells"].take(pa.array(queries)).to_pylist()]
        qi = np.repeat(np.arange(len(lists)), [len(c) for c in lists])
        qc = np.concatenate(lists) if lists else np.empty(0, "i4")
        at = np.minimum(np.searchsorted(cells, qc), max(0, len(cells) - 1))
        full = cells[at] == qc if len(cells) else np.zeros(len(qc), bool)
        qi, qc = qi[full], at[full]  # visits of cells that hold something here
        reach = np.bincount(qi, n[qc], minlength=len(queries)) if len(qi) else np.zeros(len(queries))
        dense = reach.sum() > 0.25 * len(queries) * len(entries)
        got = []

        def best(q: np.ndarray, e: np.ndarray, sim: np.ndarray) -> None:
            order = np.lexsort((e, -sim, q))
            q, e, sim = q[order], e[order], sim[order]
            first = np.arange(len(q)) - np.searchsorted(q, q, "left") < keep
            got.append((q[first], e[first], sim[first]))

        def rows_of(sim: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if sim.shape[1] > keep:
                low = np.partition(sim, sim.shape[1] - keep, axis=1)[:, sim.shape[1] - keep, None]
                return np.nonzero((sim >= low) & (sim >= least))
            return np.nonzero(sim >= least)

        # Queries in turns of so many comparisons that their results fit in memory.
        cost = np.cumsum(np.full(len(queries), len(entries)) if dense else reach)
        turns = np.searchsorted(cost, np.arange(4_000_000, (cost[-1] if len(cost) else 0) + 4_000_000, 4_000_000))
        by_query = np.argsort(qi, kind="stable")
        qi, qc = qi[by_query], qc[by_query]
        a = 0
        for b in np.unique(np.minimum(turns + 1, len(queries))):
            lo, hi = np.searchsorted(qi, a, "left"), np.searchsorted(qi, b, "left")
            own_q, own_c = qi[lo:hi], qc[lo:hi]
            if dense and hi > lo:
                seen = np.zeros((b - a, len(cells)), bool)
                seen[own_q - a, own_c] = True
                sim = v[queries[a:b]] @ v[entries].T
                sim[~np.repeat(seen, n, axis=1) | (code[queries[a:b]][:, None] == code[entries][None, :])] = -2
                x, y = rows_of(sim)
                best(queries[a:b][x], entries[y], sim[x, y])
            elif hi > lo:
                order = np.argsort(own_c, kind="stable")
                own_q, own_c = queries[own_q[order]], own_c[order]
                cut = np.flatnonzero(np.r_[True, own_c[1:] != own_c[:-1]])
                found = []
                for i, j in zip(cut, np.r_[cut[1:], len(own_c)]):
                    c = own_c[i]
                    q, mine = own_q[i:j], entries[start[c] : start[c] + n[c]]
                    sim = v[q] @ v[mine].T
                    sim[code[q][:, None] == code[mine][None, :]] = -2
                    x, y = rows_of(sim)
                    found.append((q[x], mine[y], sim[x, y]))
                best(*(np.concatenate(c) for c in zip(*found)))
            a = b
        q, e, sim = (np.concatenate(c) for c in zip(*got)) if got else (np.empty(0, int), np.empty(0, int), np.empty(0))
        return pa.table({"q": h.take(pa.array(q)), "e": h.take(pa.array(e)), "sim": pa.array(sim.astype("f8"))}, schema=pa.schema([("q", pa.binary()), ("e", pa.binary()), ("sim", pa.float64())]))

    return run


def nearest(df: DataFrame, id_col: str, vec_col: str, k: int = 5, floor: float | None = None, conf: MultiIndex = MultiIndex(), asks: Column | None = None) -> DataFrame:
    """``query``, ``neighbour``, ``similarity`` and ``rank`` of the k most similar other records of every record.

    Similarity is the cosine. ``asks`` tells which rows are queries (all if None); all rows are searched. ``floor`` leaves out less similar neighbours. Records without an id and vectors
    that are null, of another length, with a null, NaN or infinite number, or all zero take no part. Repeated
    rows of an id are one record. Ties go to the smaller id. An empty table gives no rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "neighbours")
    rows = scratch.save(df.select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).cast("array<float>").alias("v"), (F.lit(True) if asks is None else F.coalesce(asks, F.lit(False))).alias("asks")).where("id is not null and v is not null").mapInArrow(usable(conf.dim), _USABLE))
    first_ids = Window.partitionBy("h").orderBy("id")
    classes = scratch.save(rows.withColumn("r", F.dense_rank().over(first_ids)).where(F.col("r") <= k + 1).groupBy("h").agg(F.min("v").alias("v"), F.sort_array(F.collect_set("id")).alias("ids")))
    if asks is not None:
        asking = rows.where("asks").select("h").distinct().withColumn("asks", F.lit(True))
        classes = scratch.save(classes.join(asking, "h", "left").withColumn("asks", F.coalesce("asks", F.lit(False))))
    else:
        classes = classes.withColumn("asks", F.lit(True))
    n = classes.count()
    columns = ["query", "neighbour", "similarity", "rank"]
    if not n:
        return spark.createDataFrame([], "query string, neighbour string, similarity double, rank int")
    size = 2 ** max(1, round(math.log2(max(2.0, math.sqrt(n / conf.cell_rows)))))
    wanted = max(conf.sample, 32 * size)
    every = max(1, math.ceil(n / wanted))
    sample = classes.where(F.pmod(F.xxhash64("h"), F.lit(every)) == 0).select("v").limit(2 * wanted).collect()
    sample = sample or classes.select("v").limit(conf.sample).collect()
    x = np.frombuffer(b"".join(bytes(r.v) for r in sample), "<f4").reshape(-1, conf.dim)
    half = conf.dim // 2
    grid = Grid((train(x[:, :half], size, conf.rounds), train(x[:, half:], size, conf.rounds)))
    asking_v = classes.where("asks").orderBy(F.xxhash64("h")).select("v").limit(conf.checks).collect()
    asking_v = np.frombuffer(b"".join(bytes(r.v) for r in asking_v), "<f4").reshape(-1, conf.dim)
    probes = needed_probes(classes, asking_v, grid, k, floor, asks is None, conf)
    held = np.zeros(grid.side[0] * grid.side[1], np.int64)
    seen = held.copy()
    for r in classes.select("v", "asks").mapInArrow(count_blocks(grid, probes, conf.dim), "block int, held long, seen long").groupBy("block").agg(F.sum("held").alias("held"), F.sum("seen").alias("seen")).collect():
        held[r.block], seen[r.block] = r.held, r.seen  # at most one row a block
    ends = np.cumsum(held)
    per_task = min(conf.task_rows, max(500, -(-n // spark.sparkContext.defaultParallelism)))  # fewer tasks, fewer copies of a query
    first = (ends - held) // per_task
    last = np.maximum(first, (ends - 1) // per_task)
    visits = np.zeros(last.max() + 1)
    np.add.at(visits, first, seen)
    for b in np.flatnonzero(last > first):
        visits[first[b] + 1 : last[b] + 1] += seen[b]
    # A query reaches a task once whatever blocks it visits there; the same queries tell how often that is.
    if len(asking_v):
        blocks = [np.unique(x) for x in grid.block(visit(*_halves(asking_v[:128], grid.books), probes))]
        visits *= sum(len(np.unique(first[x])) for x in blocks) / sum(map(len, blocks))
    cuts = np.maximum(1, np.ceil(visits / conf.task_queries)).astype(np.int64)
    routed = classes.select("h", "v", "asks").mapInArrow(route(grid, first, last, cuts, probes, conf), _ROUTED)
    directed = scratch.save(routed.groupBy("task", "cut").applyInArrow(compare(k, floor, conf), _FOUND))
    # A visit in either direction serves both records.
    back = directed.select(F.col("e").alias("q"), F.col("q").alias("e"), "sim")
    if asks is not None:
        back = back.join(asking.select(F.col("h").alias("q")), "q", "left_semi")
    pairs = directed.unionByName(back).groupBy("q", "e").agg(F.max("sim").alias("sim"))
    ids = classes.select("h", "ids")
    between = (
        pairs.join(ids.where(F.size("ids") <= k).select(F.col("h").alias("q"), F.col("ids").alias("qs")), "q").join(ids.select(F.col("h").alias("e"), F.col("ids").alias("es")), "e")
        .select(F.explode("qs").alias("query"), "es", "sim").select("query", F.explode("es").alias("neighbour"), "sim")
    )
    many = ids.where(F.size("ids") > 1)
    within = many.select(F.explode("ids").alias("query"), "ids").unionByName(rows.join(many.where(F.size("ids") == k + 1), "h").select(F.col("id").alias("query"), "ids").distinct())
    within = within.select("query", F.explode("ids").alias("neighbour"), F.lit(1.0).alias("sim"))
    best = Window.partitionBy("query").orderBy(F.desc("sim"), "neighbour")
    if asks is not None:  # a class that asks may hold records that do not
        wanted_ids = rows.where("asks").select(F.col("id").alias("query")).distinct()
        between, within = (side.join(wanted_ids, "query", "left_semi") for side in (between, within))
    union = between.unionByName(within).where("query != neighbour").groupBy("query", "neighbour").agg(F.max("sim").alias("similarity"))
    return union.withColumn("rank", F.row_number().over(best.partitionBy("query").orderBy(F.desc("similarity"), "neighbour"))).where(F.col("rank") <= k).select(columns)
