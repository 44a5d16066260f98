import math
import re
import time

import numpy as np
from pyspark.sql import functions as F

from chronoweave.operators import resolution as R


def _by_definition(mentions, entities, threshold=0.86, margin=0.05):
    out = set()
    for g, m, v in mentions:
        found = []
        for u, h, n, w in entities:
            if g is None or g != h or v is None or w is None or sorted(re.findall(r"\d+", m)) != sorted(re.findall(r"\d+", n)):
                continue
            a, b = math.sqrt(sum(x * x for x in v)), math.sqrt(sum(x * x for x in w))
            score = round(sum(x * y for x, y in zip(v, w)) / (a * b), 6) if len(v) == len(w) and a > 0 and b > 0 else 0.0
            if score >= threshold:
                found.append((-score, u))
        found.sort()
        if found:
            out.add((g, m, found[0][1], -found[0][0], len(found) == 1 or round(found[1][0] - found[0][0], 6) >= margin))
    return out


def test_semantic_resolution_compares_every_pair(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 8))
    near = lambda: [float(x) for x in np.float32(base[rng.integers(12)] + rng.normal(size=8) * rng.choice([0, 1e-4, 0.2]))]
    odd = [[], [0.0] * 8, [1.0, 2.0], [1.0] * 7 + [0.0], [1.0] * 7]
    entities = [(f"u{i:03}", "g" if i % 5 else "h", f"name {i % 3 or ''}", near() if i % 9 else odd[i // 9 % 5]) for i in range(150)] + [("none", "g", "name", None), ("lost", None, "name", near())]
    mentions = [("g" if i % 4 else "h", f"m{'' if i % 2 else i % 3} {'x' * i}", near() if i % 11 else odd[i // 11 % 5]) for i in range(60)] + [(None, "m", near()), ("g", "unknown", None)]
    m = spark.createDataFrame(mentions, "group_id string, mention string, vector array<float>")
    e = spark.createDataFrame(entities, "uuid string, group_id string, name string, name_embedding array<float>")
    for threshold in (0.86, 0.0):
        want = _by_definition(mentions, entities, threshold)
        for cut in ({}, {"block": 7}):
            assert {tuple(r) for r in R.resolve_semantic(m, e, threshold, **cut).collect()} == want


def test_semantic_resolution_of_many_names_in_one_group(spark):
    rng = np.random.default_rng(6)
    v = np.float32(rng.normal(size=(3000, 64)))
    e = spark.createDataFrame([(f"u{i:05}", "g", "name " + chr(97 + i % 26) * (1 + i // 26), x.tolist()) for i, x in enumerate(v)], "uuid string, group_id string, name string, name_embedding array<float>")
    began = time.monotonic()
    got = R.resolve_semantic(e.select("group_id", F.col("name").alias("mention"), F.col("name_embedding").alias("vector")), e).collect()
    assert len(got) == 3000 and all(r.score == 1 and r.clear for r in got)
    assert time.monotonic() - began < 60  # nine million pairs
