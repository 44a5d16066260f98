import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from chronoweave.operators.intervals import OPEN_END, OPEN_START, periods_and_gaps

SCHEMA = "s string, p string, a timestamp, b timestamp, k1 string, pid int, e long"
T0 = datetime(2024, 1, 1)


def brute(rows):
    by = {}
    for s, p, a, b, *_ in rows:
        a = OPEN_START if a is None else int((a - datetime(1970, 1, 1)) / timedelta(microseconds=1))
        b = OPEN_END if b is None else int((b - datetime(1970, 1, 1)) / timedelta(microseconds=1))
        if b > a:
            by.setdefault((s, p), set()).add((a, b))
    out = set()
    for key, iv in by.items():
        merged = []
        for a, b in sorted(iv):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]), True)
            else:
                merged.append((a, b, False))
        side = lambda x: None if x in (OPEN_START, OPEN_END) else x
        out |= {("period", *key, side(a), side(b), m) for a, b, m in merged}
        out |= {("gap", *key, x[1], y[0], False) for x, y in zip(merged, merged[1:])}
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        s = "hot" if i % 3 == 0 else f"s{rng.randrange(150)}"
        a = T0 + timedelta(hours=rng.randrange(200_000 if s == "hot" else 900))
        b = a + timedelta(hours=rng.choice([-1, 0, 1, 1, 2, 30]))
        rows.append((s, rng.choice(["x", "y", None]), None if rng.random() < 0.01 else a, None if rng.random() < 0.02 and s != "hot" else b, "clash", 7, 9))
    rows += rows[:300]
    rows.append(("hot", "x", T0 + timedelta(hours=100), T0 + timedelta(hours=150_000), "clash", 1, 1))  # spans partitions
    got = periods_and_gaps(spark.createDataFrame(rows, SCHEMA).repartition(3), "s", "p", "a", "b").collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute(rows)


def test_empty_and_touching(spark):
    assert periods_and_gaps(spark.createDataFrame([], SCHEMA), "s", "p", "a", "b").collect() == []
    rows = [("a", "x", T0, T0 + timedelta(1), "", 0, 0), ("a", "x", T0 + timedelta(1), T0 + timedelta(2), "", 0, 0), (None, None, None, None, "", 0, 0)]
    got = {tuple(r) for r in periods_and_gaps(spark.createDataFrame(rows, SCHEMA), "s", "p", "a", "b").select("key1", "merged", F.col("start_us").isNull()).collect()}
    assert got == {("a", True, False), (None, False, True)}
