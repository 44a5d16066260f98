import os

import pytest
from pyspark.sql import functions as F

from chronoweave.functions import extract
from chronoweave.operators import predicates
from chronoweave.plans.memory import MemoryGraph

DATA = "/root/testdata/sf0.001"
NOW = "2025-03-01 00:00:00"


def test_extractor(spark):
    df = spark.createDataFrame([("e", "Michael works at Acme Corp. Alice met Michael; nobody else."), ("f", None), ("g", "")], "uuid string, content string")
    assert {(r.subject, r.predicate, r.object_name) for r in extract.facts(df, "content", "uuid").collect()} == {("Michael", "works_at", "Acme Corp"), ("Alice", "knows", "Michael")}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_graph(spark):
    g = MemoryGraph.load(spark, DATA)
    vector = list(g.facts.where(F.size("fact_embedding") == 64).orderBy("uuid").first().fact_embedding)
    assert g.search("", vector, NOW).collect() == []
    plain = g.search("manages the pump relay", vector, NOW).collect()
    assert plain and [r.score for r in plain] == sorted((r.score for r in plain), reverse=True)
    for kind in ("mentions", "cross_encoder", "mmr"):
        assert g.search("manages the pump relay", vector, NOW, rerank=kind).count() == len(plain)
    few = g.facts.orderBy("uuid").limit(5).select("uuid")
    assert {r.uuid for r in g.search("manages", vector, NOW, allowed=few).collect()} <= {r.uuid for r in few.collect()}
    assert g.search("manages", vector, NOW, filters=predicates.EdgeFilter(types=[])).collect() == []
    assert g.search("manages the pump relay", vector, NOW, decay=True).count() <= 10
    with pytest.raises(ValueError):
        g.search_depth("x", vector, NOW, "bottomless")
    nodes, edges = g.read("truth")
    assert edges.count() > 0 and nodes.count() > 0


def test_added_facts_supersede(spark):
    rows = [("g", "alice", "lives_in", "philadelphia", "2024-01-01", "2024-01-01", None), ("g", "alice", "lives_in", "los angeles", "2024-06-01", "2024-06-01", None)]
    df = spark.createDataFrame(rows, "group_id string, subj string, canonical string, obj string, created_at string, valid_at string, invalid_at string").select("group_id", "subj", "canonical", "obj", *[F.to_timestamp(c).alias(c) for c in ("created_at", "valid_at", "invalid_at")])
    g = MemoryGraph(df.limit(1), df.limit(0), df.limit(0), df.limit(0), df.limit(0))
    got = {r.obj: r.end_us for r in g.add_facts(df.where("obj = 'los angeles'")).collect()}
    assert got["los angeles"] is None and got["philadelphia"] is not None
