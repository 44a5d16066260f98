from datetime import datetime

from pyspark.sql import functions as F

from chronoweave.functions import values as V
from chronoweave.operators import cognition as C
from chronoweave.operators import resolution as R
from chronoweave.plans.providers import OfflineEmbedder, OfflineJudge


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_times(spark):
    r = one(spark, *[V.iso_time(F.lit(t)) for t in ("2024-01-02T03:04:05Z", "2024-01-02 03:04:05.5", "2024-01-02", "soon", None)], V.activation_time(F.lit("86400")))
    assert list(r)[:3] == [datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5, 500_000), datetime(2024, 1, 2)] and r[3] is None and r[4] is None and r[5] == datetime(1970, 1, 2)


def test_loose_values(spark):
    r = one(spark, V.truthy(F.lit('"Yes"')), V.truthy(F.lit("0")), V.truthy(F.lit(None).cast("string")), V.number(F.lit("x"), 2.0), V.string_list(F.lit('["a", " ", "b"]')), V.string_list(F.lit("a")), V.string_list(F.lit("")), V.unfenced(F.lit('```json\n{"a":1}\n```')))
    assert list(r) == [True, False, False, 2.0, ["a", "b"], ["a"], [], '{"a":1}']
    m = one(spark, V.merged(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))))
    assert m[0] == {"a": "1", "b": "3"}


def test_beliefs_goals_and_providers(spark):
    ep = spark.createDataFrame([("e1", "g", "I think it works. I want to learn the piano."), ("e2", "g", None)], "uuid string, group_id string, content string")
    f = spark.createDataFrame([("f1", "active", ["e1"]), ("f2", "active", ["e2"])], "uuid string, status string, episodes array<string>")
    assert [r.uuid for r in C.beliefs(f, ep).collect()] == ["f1"]
    assert "learn_the_piano" in {r.name for r in C.goals(ep).collect()}
    pairs = spark.createDataFrame([("Alice no longer works at Acme; she moved.", "Alice works at Acme"), ("Alice sings", "Alice works at Acme")], "new string, old string")
    assert OfflineJudge().contradicts(pairs).count() == 1
    assert len(OfflineEmbedder().embed(ep, "content", "v").first().v) == 64


def test_frames(spark):
    fr = spark.createDataFrame([("", "lives_in", ["resides in"]), ("", "home", ["at home"]), ("g", "lives_in", [])], "group_id string, canonical_name string, aliases array<string>")
    got = {(r.group_id, r.canonical_name): r.aliases for r in R.merge_frames(fr, "lives_in", "home").collect()}
    assert got == {("", "lives_in"): ["at home", "home", "resides in"], ("g", "lives_in"): []}
    assert R.register_frames(fr, spark.createDataFrame([("g", "lives_in", ["x"])], fr.schema)).count() == 3
    p = spark.createDataFrame([("g", "resides in"), ("h", "resides in"), ("g", "other")], "group_id string, predicate string")
    got = {(r.group_id, r.predicate): r.canonical for r in R.resolve_frames(p, fr.withColumn("cardinality", F.lit("one"))).collect()}
    assert got["h", "resides in"] == "lives_in" and got["g", "other"] == "other"
