import json
import zipfile
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.functions import decay as D
from chronoweave.functions import text as T
from chronoweave.functions import vectors as V
from chronoweave.operators import cognition as C
from chronoweave.operators import graph as G
from chronoweave.operators import identity as I
from chronoweave.operators import participants as N
from chronoweave.operators import retrieval as S
from chronoweave.operators import state as W
from chronoweave.sources import packs

#: Hashes that qualifiers must have.
HASHES = {'{"n":1}': "1239cbe2dd247e9e", '{"n":1.0}': "e914157f5219ccb3", '{"n":1000000.0}': "9456674670b93efd", '{"n":1e15}': "81ec2c2e0a9ca065", '{"n":0.0001}': "049dc54e20a53f8b", '{"season":"winter"}': "a4709ad6d8fc42b7"}
ONE = "x int"


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_hashes_and_keys(spark):
    assert {k: I.qualifier_hash_of(k) for k in HASHES} == HASHES
    assert I.qualifier_hash_of(None) == I.qualifier_hash_of("{}") == I.qualifier_hash_of("{broken") == ""
    row = one(spark, I.fact_key(F.lit(" g "), F.lit("s"), F.lit("Lives_In"), F.lit("o"), F.lit("a4709ad6d8fc42b7")).alias("k"))
    assert row.k == "g::s::lives_in::o::a4709ad6d8fc42b7"
    a, b = I.symmetric(F.lit("z"), F.lit("a"))
    assert tuple(one(spark, a, b)) == ("a", "z")


def test_cue_tokens(spark):
    r = one(spark, T.cue_tokens(F.lit("please tell me about peanuts peanuts allergy")), T.cue_tokens(F.lit("hi OK uh um AI, Go, UK, R, and US.")), T.cue_tokens(F.lit("")))
    assert r[0] == ["peanuts", "allergy"] and {"ai", "uk", "us", "r"} <= set(r[1]) and r[2] == []


def test_text(spark):
    r = one(spark, T.snake_case(F.lit("  Lives In! ")), T.snake_case(F.lit("")), T.profile_summary(F.lit("Ann"), F.array(F.lit("likes tea."), F.lit(""), F.lit("knows Bo"))), T.goal_clauses(F.lit("I want to learn the piano. My goal is to rest more!")), T.looks_like_belief(F.lit("It seems fine")), T.classify_episode(F.lit("Please improve this"), F.lit(None)), T.query_ngrams(F.lit("a cat, Cat sat")))
    assert r[0] == "lives_in" and r[1] == "unknown" and r[2] == "Ann: likes tea; knows Bo."
    assert "learn the piano" in r[3] and r[4] and r[5] == "optimization_request" and r[6] == ["cat Cat sat", "cat Cat", "Cat sat", "cat", "sat"]
    text = "Nothing here. The client failed with ECONNRESET when PGSSLMODE=require was set. Other."
    assert "ECONNRESET" in T.snippets(text, ["econnreset", "pgsslmode"], 1)[0]


def test_vectors(spark):
    a, b = F.lit([1.0, 0.0]), F.lit([1.0])
    assert tuple(one(spark, V.cosine_permissive(a, b), V.cosine_strict(a, b), V.cosine_strict(a, F.lit([0.0, 0.0])))) == (1.0, 0.0, 0.0)


def test_decay(spark):
    now, old = F.lit("2024-01-31").cast("timestamp"), F.lit("2024-01-01").cast("timestamp")
    at = lambda t, w: F.array(F.struct(F.lit(t).cast("timestamp").alias("at"), F.lit(w).alias("weight")))
    none = F.lit(None).cast("double")
    r = one(spark, D.base_level(at("2024-01-30 23:00:00", 1.0), none, old, now), D.base_level(at("2024-01-01", 1.0), none, old, now), D.base_level(at("2024-01-01", 0.15), none, old, now), D.effective_confidence(F.lit(0.7), F.lit(0.1), F.lit(True)), D.base_level(F.slice(at("2024-01-01", 1.0), 1, 0), none, old, now))
    assert r[0] > r[1] > r[2] and r[3] == 0.7 and r[4] == -10


def test_replay_depends_on_arrival():
    assert [(h[1], h[2], h[3]) for h in W.replay_slot([(1, "A", 2, None), (2, "A", 6, None), (3, "B", 4, None)])] == [("A", 2, 4), ("B", 4, None)]
    assert [(h[1], h[2], h[3]) for h in W.replay_slot([(1, "A", 2, None), (2, "B", 4, None), (3, "A", 6, None)])] == [("A", 2, 4), ("B", 4, 6), ("A", 6, None)]
    assert [(h[1], h[2], h[3]) for h in W.replay_slot([(1, "B", 5, 10), (2, "B", 8, None)])] == [("B", 5, 10)]


def test_recompute_equals_ordered_replay(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{s}", int(o), "ABC"[rng.integers(3)], int(t)) for s in range(30) for o, t in enumerate(np.sort(rng.choice(1000, 12, replace=False)))]
    df = spark.createDataFrame(rows, "slot string, ord long, obj string, start_us long")
    replayed = {(r.slot, r.obj, r.start_us, r.end_us) for r in W.replay(df.withColumn("end_us", F.lit(None).cast("long"))).collect()}
    again = W.recompute(df, ["slot"], "obj", "start_us", "ord", F.lit(10**6))
    assert {(r.slot, r.obj, r.start_us, r.ends_at) for r in again.collect()} == replayed


def test_rank_fusion_and_mmr(spark):
    a, b = (spark.createDataFrame(x, "u string, rank int") for x in ([("a", 1), ("b", 2)], [("b", 1), ("a", 2)]))
    got = S.fuse([a, b], "u").orderBy("ordinal").collect()
    assert [r.u for r in got] == ["a", "b"] and got[0].score == got[1].score == pytest.approx(1 / 61 + 1 / 62)
    v = [np.array(x, float) for x in ([1, 0], [1, 0.01], [0.6, 0.8])]
    assert S.mmr_order(np.array([1.0, 0]), v, 0.3, 2) == [0, 2]
    assert S.mmr_order(np.array([1.0, 0]), [None, v[0]], 0.5, 5) == [1, 0]


def test_bm25_without_words(spark):
    df = spark.createDataFrame([("a", "x y"), ("b", None)], "u string, t string")
    assert S.bm25(df, "u", "t", "").collect() == [] and [r.u for r in S.bm25(df, "u", "t", "x").collect()] == ["a"]
    assert S.bm25(df.limit(0), "u", "t", "x").collect() == []


def test_spread(spark):
    rows = [("seed", 1.0, 1, "a", "b", ["e"]), ("near", 0.4, 2, "b", "c", []), ("far", 0.4, 3, "x", "y", [])]
    got = {r.uuid: r.score for r in S.spread(spark.createDataFrame(rows, "uuid string, score double, ordinal long, subj string, obj string, episodes array<string>"), S.Search(seeds=1, spread_weight=0.2)).collect()}
    assert got["near"] > got["far"] == 0.4


def test_communities(spark):
    rows = [("g", f"n{i:03d}", f"n{i + 1:03d}", None) for i in range(60)] + [("g", "z1", "z2", None), ("h", "n000", "q", None), ("g", "z2", "n000", datetime(2024, 1, 1)), ("g", "solo", "solo", None)]
    got = {(r.group_id, r.node): r.community for r in G.communities(spark.createDataFrame(rows, "group_id string, subj string, obj string, invalid_at timestamp")).collect()}
    assert {v for (g, n), v in got.items() if g == "g" and n.startswith("n")} == {"n000"} and got["g", "z2"] == "z1" and got["h", "q"] == "n000" and ("g", "solo") not in got
    assert G.communities(spark.createDataFrame([], "group_id string, subj string, obj string, invalid_at timestamp")).collect() == []


def test_participants(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    f = spark.createDataFrame([("g", "f1", "a", "b", datetime(2024, 1, 1))], "group_id string, uuid string, subj string, obj string, created_at timestamp")
    refs = N.write_refs(f, F.col("subj"), F.array("obj"))
    assert {(r.actor, r.roles) for r in N.visible(f, refs).collect()} == {("a", "asserted"), ("b", "witnessed")} and N.visible(f, refs, "c").collect() == []
    want = spark.createDataFrame([("a", "c", "f1"), ("b", "d", "f1")], "giver string, receiver string, fact_uuid string")
    new = N.grant(refs, want, now)
    assert [r.actor for r in new.collect()] == ["c"]
    assert N.grant(refs.unionByName(new.select(refs.columns)), want, now).collect() == []
    assert N.visible(f, N.close(refs, F.col("actor") == "b", now), "b").collect() == []


def test_pack_round_trip(spark, tmp_path):
    e = spark.createDataFrame([("u1", "Ann", [0.1])], "uuid string, name string, name_embedding array<float>")
    packs.write_folder({"entities": packs.export_rows(e)}, str(tmp_path / "p"), "g")
    assert packs.validate_folder(str(tmp_path / "p"))["counts"]["entities"] == 1
    assert "name_embedding" not in json.loads((tmp_path / "p/entities.jsonl").read_text())
    packs.write_archive(str(tmp_path / "p"), str(tmp_path / "p.zip"))
    packs.extract_archive(str(tmp_path / "p.zip"), str(tmp_path / "q"))
    assert packs.read_lines(spark, str(tmp_path / "q/entities.jsonl"), "uuid string, name string").collect() == [("u1", "Ann")]
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../x", "1")
    with pytest.raises(packs.PackError):
        packs.extract_archive(str(tmp_path / "bad.zip"), str(tmp_path / "r"))
    (tmp_path / "p/entities.jsonl").write_text("{}\n")
    with pytest.raises(packs.PackError):
        packs.validate_folder(str(tmp_path / "p"))


def test_import_twice_adds_nothing(spark):
    ents = spark.createDataFrame([("s1", "Ann"), ("s2", "Bo")], "uuid string, name string")
    have = spark.createDataFrame([("t1", "Ann", "g")], "uuid string, name string, group_id string")
    m = packs.remap_entities(ents, have, "g")
    edges = spark.createDataFrame([("e1", "s1", "knows", "s2", None), ("e2", "s1", "knows", "gone", None)], "uuid string, subj string, pred string, obj string, invalid_at timestamp")
    first = packs.remap_edges(edges, m, spark.createDataFrame([], "fact_key string"), "g")
    assert first.count() == 1 and packs.remap_edges(edges, m, first.select("fact_key"), "g").count() == 0


def test_debounce(spark):
    rows = [("u", datetime(2024, 1, 1, 0, 0, s), s) for s in (0, 1, 2, 3, 4, 5, 30)]
    got = sorted((r.session, r.batch, r.n_events) for r in C.debounce(spark.createDataFrame(rows, "k string, ts timestamp, id long"), "k", "ts", "id", 8, 5).collect())
    assert got == [(1, 0, 5), (1, 1, 1), (2, 0, 1)]


def test_silence_sweeps_every_group(spark):
    rows = [(f"{g}{i}", g, i) for g in "ab" for i in range(3)]
    strong = spark.createDataFrame(rows, "uuid string, group_id string, day int").selectExpr("uuid", "group_id", "'active' as status", "'episodic' as stability", "timestampadd(DAY, day, timestamp'2020-01-01') as created_at", "-9D as level")
    now = F.lit("2024-01-01").cast("timestamp")
    assert {r.uuid for r in C.silence(strong, now, most=2).collect()} == {"a0", "a1", "b0", "b1"}
    assert C.silence(strong, now, most=2, by=()).count() == 2
