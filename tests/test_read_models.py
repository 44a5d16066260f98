from datetime import datetime

from pyspark.sql import functions as F

from chronoweave.operators import cognition as C
from chronoweave.operators import resolution as R
from chronoweave.operators import views as X

ITEMS = "uuid string, group_id string, library_item_id string, title string, kind string, relationship string, summary string, available boolean, created_at timestamp, updated_at timestamp"
T0, T1, T2 = datetime(2024, 1, 1), datetime(2024, 2, 1), datetime(2024, 3, 1)


def test_affect_is_of_the_dominant_emotion(spark):
    rows = [("a", "frustrated, stuck, excited"), ("b", "love hate"), ("c", None), ("d", ""), ("e", "plain words")]
    df = spark.createDataFrame(rows, "uuid string, content string")
    got = {r.uuid: (r.emotion, r.polarity, r.intensity) for r in C.affect(df, C.lexicon(df)).collect()}
    assert got == {"a": ("frustration", round((-0.7 - 0.5 * 0.7) / 1.7, 3), 0.85), "b": ("excitement", 0.7, 0.45)}
    assert C.affect(df.limit(0), C.lexicon(df)).collect() == []


def test_slot_closing(spark):
    cases = [
        ("assert", "one_current", None, False, True, True), ("assert", "one_current", "uncertain", True, True, False), ("assert", "many_current", "coexist", True, True, False), ("assert", None, None, True, True, True),
        ("assert", None, None, True, False, False), ("qualify", "one_current", "replace", True, True, False), ("correct", "many_current", "coexist", False, True, True), ("correct", None, None, False, False, False),
    ]
    df = spark.createDataFrame(cases, "op string, cardinality string, policy string, flag boolean, from_user boolean, want boolean")
    got = df.select("want", R.singleton_decision(F.col("op"), F.col("cardinality"), F.col("flag"), F.col("from_user"), F.col("policy")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_frames_keep_their_columns(spark):
    frames = R.default_frames(spark).withColumnRenamed("canonical", "canonical_name").withColumn("group_id", F.lit(""))
    new = spark.createDataFrame([("", "owns", ["keeps"], "one_current"), ("g", "leads", [], "many_current")], "group_id string, canonical_name string, aliases array<string>, cardinality string")
    got = {(r.group_id, r.canonical_name): r for r in R.register_frames(frames, new).collect()}
    assert len(got) == 16 and got["", "owns"].cardinality == "one_current" and got["", "spouse_of"].policy == "replace" and got["g", "leads"].policy is None


def test_terms_tie_by_first_seen(spark):
    df = spark.createDataFrame([("g", 2, "b", "zebra apple zebra"), ("g", 1, "a", "melon apple have"), ("g", 3, "c", None)], "grp string, at int, id string, text string")
    assert [(r.term, r.n, r.place) for r in C.term_ranks(df, ["grp"], 3).orderBy("place").collect()] == [("apple", 2, 1), ("zebra", 2, 2), ("melon", 1, 3)]


def items(spark, rows):
    return spark.createDataFrame([(u, g, i, title, "", None, "s", av, c, c) for u, g, i, title, av, c in rows], ITEMS)


def test_resources_are_upserted(spark):
    known = items(spark, [("r1", "g", "book", "Old", True, T0), ("r2", "g", "map", "Map", True, T0), (None, None, "x", "x", True, T0)])
    new = items(spark, [("n1", "g", "book", "New", True, T1), ("n0", "g", "book", "Older", True, T0), ("n3", "h", "book", "Other", True, T1)])
    got = {(r.group_id, r.library_item_id): r for r in X.upsert_resources(known, new, F.lit(T2)).collect()}
    assert set(got) == {("g", "book"), ("g", "map"), ("h", "book")}
    book = got["g", "book"]
    assert (book.uuid, book.title, book.created_at, book.updated_at) == ("r1", "New", T0, T2) and got["g", "map"].updated_at == T0 and got["h", "book"].uuid == "n3"
    off = X.set_availability(known, spark.createDataFrame([("g", "map", False)], "group_id string, library_item_id string, available boolean"), F.lit(T2))
    page = X.list_resources(off, "g").collect()
    assert [r.uuid for r in page] == ["r1"] and (page[0].kind, page[0].relationship) == ("document", "reference_material")
    assert X.upsert_resources(known.limit(0), new.limit(0), F.lit(T2)).collect() == []


def test_resource_owner_and_links(spark):
    entities = spark.createDataFrame([("e1", "user:ann", "bob", ["User"]), ("e2", "user:ann", "ann", ["Person"]), ("e3", "user:kim", "x", ["User"]), ("e4", "ws", "ws", ["User"])], "uuid string, group_id string, name string, labels array<string>")
    owners = X.resource_owner(entities)
    assert {(r.group_id, r.owner) for r in owners.collect()} == {("user:ann", "e2"), ("user:kim", "e3")}
    res = items(spark, [("r1", "user:ann", "book", "B", True, T0)])
    eps = spark.createDataFrame([("p1", "user:ann", "source:book"), ("p2", "user:ann", "source:other"), ("p3", "ws", "source:book")], "uuid string, group_id string, source_description string")
    facts = spark.createDataFrame([("f1", "e2", "e9", ["p1", "p1"]), ("f2", "e8", None, ["p2"])], "uuid string, subj string, obj string, episodes array<string>")
    got = {(r.resource, r.relation, r.target) for r in X.resource_links(res, eps, facts, owners).collect()}
    assert got == {("r1", "owner", "e2"), ("r1", "consulted_in", "p1"), ("r1", "supports", "e9")}


def test_consolidation_by_fact_key(spark):
    kinds = "group_id string, fact_key string, uuid string, confidence double, status string, stability string, episodes array<string>"
    rows = [("g", "k", "f2", 0.6, "active", "episodic", [f"p{i}" for i in range(6)]), ("g", "k", "f1", 0.6, "active", "episodic", [f"p{i}" for i in range(4, 8)] + ["gone"]), ("g", "k", "f0", 0.9, "superseded", "episodic", ["p9"])]
    rows += [("g", "", "f3", 0.6, "active", "episodic", [f"p{i}" for i in range(9)]), ("g", "short", "f4", 0.6, "active", "episodic", ["p0"] * 9), ("g", "done", "f5", 0.6, "active", "consolidated", [f"p{i}" for i in range(9)])]
    eps = spark.createDataFrame([(f"p{i}", datetime(2024, 1, 1 + 2 * i)) for i in range(10)], "uuid string, created_at timestamp")
    got = C.consolidation(spark.createDataFrame(rows, kinds), eps).collect()
    assert [tuple(r) for r in got] == [("g", "k", 2, 9, 0.7, "f1")]
    assert C.consolidation(spark.createDataFrame(rows, kinds), eps, days=15).collect() == []
