import numpy as np

from pyspark.sql import functions as F

from chronoweave.llm.neighbours import MultiIndex, nearest, place, visit

SCHEMA = "uuid string, v array<float>, h string, task int"


def run(spark, vectors, **kw):
    rows = [(u, None if v is None else [None if x is None else float(x) for x in v], "clash", 3) for u, v in vectors]
    return nearest(spark.createDataFrame(rows, SCHEMA).repartition(3), "uuid", "v", **kw).collect()


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(700, 64))
    x = np.vstack([base, base[:300] + 0.2 * rng.normal(size=(300, 64)), base[:60] * 7])
    ids = [f"r{i:05d}" for i in range(len(x))]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = unit @ unit.T
    np.fill_diagonal(sim, -2)
    want = {(ids[i], ids[j]) for i in range(len(x)) for j in sorted(range(len(x)), key=lambda j: (-sim[i, j], j))[:5] if sim[i, j] >= 0.9}
    rows = run(spark, list(zip(ids, x)), k=5, floor=0.9)
    got = {(r.query, r.neighbour) for r in rows}
    assert len(got & want) >= 0.99 * len(want) and not got - want
    assert all(abs(r.similarity - sim[int(r.query[1:]), int(r.neighbour[1:])]) < 1e-3 for r in rows)


def test_whole_lists_with_many_probes(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 64))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = unit @ unit.T
    np.fill_diagonal(sim, -2)
    want = {(i, j) for i in range(300) for j in np.argsort(-sim[i])[:5]}
    got = {(int(r.query), int(r.neighbour)) for r in run(spark, [(str(i), v) for i, v in enumerate(x)], k=5, conf=MultiIndex(probes=64))}
    assert len(got & want) >= 0.9 * len(want)


def test_copies_are_linear(spark):
    v = np.ones(64)
    got = run(spark, [(f"c{i:03d}", v) for i in range(200)] + [("c000", v)], k=5, floor=0.9)
    assert len(got) == 200 * 5
    assert {r.neighbour for r in got if r.query == "c150"} == {f"c{i:03d}" for i in range(5)}


def test_unusable(spark):
    bad = [("a", None), ("b", [1.0] * 63), ("c", [0.0] * 64), ("d", [float("nan")] + [1.0] * 63), ("e", [float("inf")] + [1.0] * 63), ("f", [None] + [1.0] * 63), (None, [1.0] * 64), ("g", [1.0] * 64)]
    assert run(spark, bad, k=5, floor=0.9) == [] and run(spark, [], k=5) == []
    assert {(r.query, r.neighbour) for r in run(spark, [*bad, ("h", [2.0] * 64)], k=5, floor=0.9)} == {("g", "h"), ("h", "g")}


def test_visit_order():
    rng = np.random.default_rng(2)
    d1, d2 = rng.random((20, 9)), rng.random((20, 7))
    cells = visit(d1, d2, 12)
    total = (d1[:, :, None] + d2[:, None, :]).reshape(20, -1)
    assert np.allclose(np.take_along_axis(total, cells, 1), np.sort(total, axis=1)[:, :12])


def test_recall_is_reached_without_structure(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 64))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = unit @ unit.T
    np.fill_diagonal(sim, -2)
    want = {(i, j) for i in range(3000) for j in np.argsort(-sim[i])[:5]}
    rows = [(str(i), v) for i, v in enumerate(x)]
    got = {(int(r.query), int(r.neighbour)) for r in run(spark, rows, k=5)}
    assert len(got & want) >= 0.9 * len(want)
    exact = {(int(r.query), int(r.neighbour)) for r in run(spark, rows, k=5, conf=MultiIndex(recall=1.0))}
    assert len(exact & want) >= len(want) - 4


def test_some_rows_ask(spark):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(60, 64)), 3, axis=0)  # three copies each, of which one may ask
    rows = [(f"{i:03d}", v) for i, v in enumerate(x)]
    whole = run(spark, rows, k=4, conf=MultiIndex(recall=1.0))
    some = run(spark, rows, k=4, conf=MultiIndex(recall=1.0), asks=F.col("uuid") % 10 == 0)
    assert {(r.query, r.neighbour, r.rank) for r in some} == {(r.query, r.neighbour, r.rank) for r in whole if int(r.query) % 10 == 0}
    assert run(spark, rows, k=4, asks=F.lit(None).cast("boolean")) == []


def test_small_tasks_and_large_grids_give_the_same(spark, monkeypatch):
    from chronoweave.llm import neighbours as N

    rng = np.random.default_rng(7)
    base = rng.normal(size=(500, 64))
    x = np.vstack([base, base + 0.1 * rng.normal(size=(500, 64))])
    rows = [(f"{i:04d}", v) for i, v in enumerate(x)]
    pairs = lambda **kw: {(r.query, r.neighbour) for r in run(spark, rows, k=3, floor=0.8, **kw)}
    want = pairs()
    assert len(want) >= 1000 and pairs(conf=MultiIndex(task_rows=60, task_queries=40)) == want
    monkeypatch.setattr(N, "_SIDE", 4)
    assert pairs(conf=MultiIndex(cell_rows=4, task_rows=100, task_queries=64)) >= {p for p in want if abs(int(p[0]) - int(p[1])) == 500}


def test_place_counts_the_cells_before():
    rng = np.random.default_rng(8)
    d1, d2 = rng.random((10, 9)), rng.random((10, 7))
    cells = visit(d1, d2, 30)
    assert (place(d1, d2, cells[:, 20]) == 20).all()


def test_equal_halves_lose_no_vector(spark):
    rng = np.random.default_rng(9)
    x = np.hstack([np.repeat(rng.normal(size=(3, 32)), 200, axis=0), rng.normal(size=(600, 32)) * 0.3])  # few different first halves, so centroids coincide
    rows = [(f"{i:03d}", v) for i, v in enumerate(x)]
    got = {r.query for r in run(spark, rows, k=2, conf=MultiIndex(recall=1.0))}
    assert len(got) == 600 and len({r.query for r in run(spark, rows, k=2)}) == 600
