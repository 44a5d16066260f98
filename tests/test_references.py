from datetime import datetime

from pyspark.sql import functions as F

from chronoweave.operators import references as R
from chronoweave.sources.tables import bare_key

T1, T2, T3 = datetime(2024, 1, 5), datetime(2024, 2, 5), datetime(2024, 3, 5)


def run(spark, facts, entities, gone):
    f = spark.createDataFrame(facts, "uuid string, link string, created_at timestamp, parent string, key string")
    e = spark.createDataFrame(entities, "uuid string, created_at timestamp, tbl string")
    d = spark.createDataFrame(gone, "tbl string, uuid string, deleted_at timestamp")
    refs = [R.children(f, "fact", "link", "uuid", bare_key(F.col("link"), "entity"), "entity", "created_at")]
    return R.broken_references(refs, {"entity": (e, "uuid", "created_at")}, d)


def test_reasons(spark):
    facts = [("f1", "entity:⟨a⟩", T2, "", ""), ("f2", " entity:b ", T2, "", ""), ("f3", "c", T2, "", ""), ("f4", "d", T2, "", ""), ("f5", "  ", T2, "", ""), ("f6", None, T2, "", ""), ("f7", "d", None, "", ""), ("f3", "c", T2, "", "")]
    entities = [("a", T1, ""), ("d", T3, ""), ("e", T1, ""), (None, T1, "")]
    gone = [("entity", "b", T1), ("entity", "e", T1), ("other", "c", T1)]
    out = run(spark, facts, entities, gone)
    assert sorted((r.record_key, r.ref_uuid, r.reason, r.ref_month) for r in out.collect()) == [("f2", "b", "deleted", "2024-02"), ("f3", "c", "missing", "2024-02"), ("f4", "d", "late", "2024-02")]
    assert sum(r.n_refs for r in R.broken_report(out).collect()) == 3


def test_empty_sides(spark):
    assert run(spark, [], [], []).collect() == []
    assert [r.reason for r in run(spark, [("f", "x", T1, "", "")], [], []).collect()] == ["missing"]


def test_hot_key(spark):
    rows = [(f"f{i}", "gone", T1, "", "") for i in range(3000)]
    assert run(spark, rows, [], []).count() == 3000
