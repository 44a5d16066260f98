import random

from chronoweave.llm.components import components


def brute(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in up}


def run(spark, edges):
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in edges], "a string, b string, id string, label int")
    return {r.id: r.component for r in components(df, "a", "b").collect()}


def test_random_and_dirty(spark):
    rng = random.Random(1)
    edges = [(f"v{rng.randrange(400):04d}", f"v{rng.randrange(400):04d}") for _ in range(260)] + [(None, "v0001"), ("v0002", None), ("v0003", "v0003")]
    edges += edges[:40]
    assert run(spark, edges) == brute(edges)


def test_chain_and_hub(spark):
    chain = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(150)]
    hub = [("hub", f"x{i}") for i in range(500)]
    assert run(spark, chain + hub) == brute(chain + hub)


def test_empty(spark):
    assert run(spark, []) == {} and run(spark, [("a", "a"), (None, None)]) == {}
