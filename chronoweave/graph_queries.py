"""Queries of the memory graph's operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.functions import decay as D
from chronoweave.functions import extract
from chronoweave.functions import text as T
from chronoweave.functions import vectors as V
from chronoweave.operators import cognition as C
from chronoweave.operators import graph as G
from chronoweave.operators import identity as I
from chronoweave.operators import participants as N
from chronoweave.operators import predicates as P
from chronoweave.operators import resolution as R
from chronoweave.operators import retrieval as S
from chronoweave.operators import state as W
from chronoweave.operators import views as X
from chronoweave.plans.memory import MemoryGraph
from chronoweave.sources import model as M
from chronoweave.sources import packs
from chronoweave.sources.tables import load

NOW, AT = "2025-03-01 00:00:00", "2024-06-01 00:00:00"
SEARCH = "manages the pump relay or cold store"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_FACT = r"""fact as (select uuid, group_id, source_node_uuid as subj, target_node_uuid as obj, lower(regexp_replace(coalesce(name, ''), '^\s+|\s+$', '', 'g')) as pred, coalesce(fact, '') as fact, fact_embedding,
  coalesce(episodes, []) as episodes, valid_at, invalid_at, expired_at, created_at, coalesce(nullif(trim(status), ''), 'active') as status, coalesce(nullif(trim(source_type), ''), 'user') as source_type,
  coalesce(confidence, 1.0) as confidence, coalesce(singleton, false) as singleton,
  case when trim(coalesce(canonical_name, '')) <> '' then lower(trim(canonical_name)) else lower(regexp_replace(coalesce(name, ''), '^\s+|\s+$', '', 'g')) end as canonical, qualifiers,
  coalesce(reinforcement_count, 1) as reinforcement_count, coalesce(recall_count, 0) as recall_count, coalesce(nullif(trim(stability), ''), 'episodic') as stability
  from (select *, row_number() over (partition by uuid order by coalesce(recall_count, 0) desc) as rn from relates_to where uuid is not null) where rn = 1)"""
_ENT = """ent as (select uuid, group_id, coalesce(name, '') as name, coalesce(labels, ['Entity']) as labels, name_embedding, created_at, canonical_name, coalesce(mention_count, 0) as mention_count
  from (select *, row_number() over (partition by uuid order by merged_into asc nulls last) as rn from entity where uuid is not null) where rn = 1)"""
_EP = """ep as (select uuid, group_id, coalesce(nullif(trim(source), ''), 'message') as source, coalesce(content, '') as content, created_at, coalesce(ingestion_complete, false) as ingestion_complete, cognition_processed_at
  from (select *, row_number() over (partition by uuid order by created_at, content asc nulls last) as rn from episode where uuid is not null) where rn = 1)"""
_AL = """al as (select uuid, group_id, alias, normalized_alias, entity_uuid, coalesce(confidence, 1.0) as confidence from (select *, row_number() over (partition by uuid order by created_at) as rn from entity_alias where uuid is not null) where rn = 1)"""
_X = r"""x as (select fact_id, group_id, coalesce(regexp_replace(subject, '^\s+|\s+$', '', 'g'), '') as subject, lower(coalesce(regexp_replace(predicate, '^\s+|\s+$', '', 'g'), '')) as predicate, coalesce(regexp_replace(object_name, '^\s+|\s+$', '', 'g'), '') as object_name,
  lower(coalesce(nullif(trim(fact_operation), ''), 'assert')) as operation, lower(coalesce(nullif(trim(memory_class), ''), 'objective')) as memory_class, coalesce(singleton, false) as singleton
  from (select *, row_number() over (partition by fact_id order by episode_uuid) as rn from extracted_fact where fact_id is not null) where rn = 1)"""
_PARTS = {"fact": _FACT, "ent": _ENT, "ep": _EP, "al": _AL, "x": _X}


def query(needs: str = "", sql: str | None = None):
    """Register a query; ``sql`` may use the tables named in ``needs`` and :NOW and :AT."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            head = ", ".join(_PARTS[n] for n in needs.split())
            body = sql.strip()
            if head:
                body = f"with {head}, {body[5:]}" if body.startswith("with ") else f"with {head} {body}"
            ORACLE[f.__name__] = body.replace(":NOW", f"timestamp '{NOW}'").replace(":AT", f"timestamp '{AT}'")
        return f

    return add


def us(c: str | Column) -> Column:
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def _or(c: str | Column) -> Column:
    """-1 for null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(-1).cast("long"))


_now, _at = lambda: P.instant(NOW), lambda: P.instant(AT)
_LIVE = "status = 'active' and (valid_at is null or valid_at <= :NOW) and (invalid_at is null or invalid_at > :NOW)"
_HELD = "(valid_at is null or valid_at <= :AT) and (invalid_at is null or invalid_at > :AT) and (expired_at is null or expired_at > :AT)"


# Temporal state


@query("fact", f"select uuid, group_id, subj, pred, obj from fact where {_LIVE}")
def current_facts(spark, d):
    return W.current_facts(M.facts(spark, d), _now()).select("uuid", "group_id", "subj", "pred", "obj")


@query("fact", f"select group_id, subj, canonical, count(*) as n_facts, string_agg(distinct obj, ',' order by obj) as objects from fact where {_LIVE} group by all")
def current_profile(spark, d):
    return W.current_profile(M.facts(spark, d), _now())


@query("fact", f"select uuid, status from fact where {_HELD}")
def facts_as_of(spark, d):
    return W.facts_as_of(M.facts(spark, d), _at()).select("uuid", "status")


@query("fact", f"select subj, canonical, obj, uuid from (select *, row_number() over (partition by subj, canonical, obj order by valid_at desc nulls last, uuid) as n from fact where {_HELD}) where n = 1")
def state_as_of(spark, d):
    return W.state_as_of(M.facts(spark, d), _at()).select("subj", "canonical", "obj", "uuid")


@query("fact", f"select group_id, count(*) filter (where {_LIVE} and (expired_at is null or expired_at > :NOW)) as n_search, count(*) filter (where {_LIVE}) as n_state, count(*) filter (where status = 'active' and (invalid_at is null or invalid_at > :NOW) and (expired_at is null or expired_at > :NOW)) as n_valid from fact group by group_id")
def active_predicates(spark, d):
    n = _now()
    return M.facts(spark, d).groupBy("group_id").agg(F.count_if(P.active_in_search(n)).alias("n_search"), F.count_if(P.active_in_state(n)).alias("n_state"), F.count_if(P.still_valid(n)).alias("n_valid"))


@query("fact", "select uuid, group_id, subj, canonical from fact where status = 'needs_resolution'")
def conflicts(spark, d):
    return M.facts(spark, d).where("status = 'needs_resolution'").select("uuid", "group_id", "subj", "canonical")


@query("fact", f"select group_id, subj, canonical, count(distinct obj) as n_objects, min(uuid) as first_uuid, count(*) as n_facts from fact where singleton and {_LIVE} group by all having count(distinct obj) > 1")
def conflict_peers(spark, d):
    return W.conflict_peers(M.facts(spark, d), _now())


@query("", """with r as (select *, lag(o_orderpriority) over w as before, row_number() over w as n from orders window w as (partition by o_custkey order by o_orderdate asc nulls first, o_orderkey)),
s as (select * from r where n = 1 or before is distinct from o_orderpriority)
select o_custkey, o_orderkey, o_orderpriority, epoch_us(o_orderdate) as start_us, coalesce(epoch_us(lead(o_orderdate) over w), -1) as end_us, coalesce(lead(o_orderkey) over w, -1) as superseded_by,
  case when lead(o_orderdate) over w <= timestamp '1998-01-01' then 'superseded' else 'active' end as state from s window w as (partition by o_custkey order by o_orderdate asc nulls first, o_orderkey)""")  # fmt: skip
def scd_slots(spark, d):
    log = load(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    return W.recompute(log, ["o_custkey"], "o_orderpriority", "o_orderdate", "o_orderkey", P.instant("1998-01-01")).select("o_custkey", "o_orderkey", "o_orderpriority", us("o_orderdate").alias("start_us"), _or(us("ends_at")).alias("end_us"), _or("superseded_by").alias("superseded_by"), "state")


@query()
def slot_replay(spark, d):
    f = M.facts(spark, d).where("singleton and valid_at is not null")
    return W.replay(f.select(F.concat_ws("|", "group_id", "subj", "canonical", F.coalesce("qualifiers", F.lit(""))).alias("slot"), us("created_at").alias("ord"), "obj", us("valid_at").alias("start_us"), us("invalid_at").alias("end_us")))


@query("fact", """with e as (select uuid, valid_at + interval 200 day as e from fact where canonical = 'lives_in' and valid_at is not null), j as (select f.*, e.e, (e.e is not null and (f.invalid_at is null or f.invalid_at > e.e)) as a from fact f left join e using (uuid))
select uuid, coalesce(epoch_us(case when a then e else invalid_at end), -1) as end_us, case when a and e <= :NOW then 'superseded' else status end as status, case when a then 'rule' end as superseded_by from j""")  # fmt: skip
def invalidate_future(spark, d):
    f = M.facts(spark, d)
    ends = f.where("canonical = 'lives_in' and valid_at is not null").select("uuid", F.expr("valid_at + interval 200 day").alias("end_at"), F.lit("rule").alias("by"))
    return W.invalidate(f, ends, _now()).select("uuid", _or(us("invalid_at")).alias("end_us"), "status", "superseded_by")


@query("fact ent x", "select distinct f.uuid from x join ent s on s.group_id = x.group_id and s.name = x.subject join ent o on o.group_id = x.group_id and o.name = x.object_name join fact f on f.subj = s.uuid and f.obj = o.uuid and f.pred = x.predicate where x.operation = 'retract' and f.status = 'active' and f.invalid_at is null")
def terminate_facts(spark, d):
    f, e, x = M.facts(spark, d).where("status = 'active' and invalid_at is null"), M.entities(spark, d), M.extracted(spark, d).where("operation = 'retract'")
    end = lambda c, to: e.select("group_id", F.col("name").alias(c), F.col("uuid").alias(to))
    told = x.join(end("subject", "subj"), ["group_id", "subject"]).join(end("object_name", "obj"), ["group_id", "object_name"]).select("subj", "obj", F.col("predicate").alias("pred"))
    return f.join(told, ["subj", "obj", "pred"], "left_semi").select("uuid")


# Identities


def _keyed(f: DataFrame) -> DataFrame:
    return f.withColumn("fact_key", I.fact_key(F.col("group_id"), F.col("subj"), F.col("pred"), F.col("obj"), F.lit("")))


_KEYED = "k as (select *, group_id || '::' || subj || '::' || pred || '::' || obj as fact_key from fact)"


@query("fact", f"with {_KEYED} select uuid, fact_key, group_id || '::' || subj || '::' || canonical || '::' as slot_key from k")
def fact_keys(spark, d):
    f = _keyed(M.facts(spark, d))
    return f.select("uuid", "fact_key", I.slot_key(F.col("group_id"), F.col("subj"), F.col("canonical"), F.lit("")).alias("slot_key"))


@query()
def qualifier_hashes(spark, d):
    return M.facts(spark, d).where("qualifiers is not null").select("uuid", I.qualifier_hash("qualifiers").alias("qhash"))


@query("fact", "with m as (select distinct group_id, unnest(episodes) as e, subj from fact) select group_id, e as episode, subj as entity, sha256(group_id || chr(31) || e || chr(31) || subj) as mention_id from m where subj is not null")
def mention_ids(spark, d):
    m = M.facts(spark, d).select("group_id", F.explode("episodes").alias("episode"), F.col("subj").alias("entity")).where("entity is not null").distinct()
    return m.withColumn("mention_id", I.mention_id(F.col("group_id"), F.col("episode"), F.col("entity")))


@query("fact", "select uuid, least(subj, obj) as a, greatest(subj, obj) as b from fact where canonical = 'knows'")
def symmetric_pairs(spark, d):
    a, b = I.symmetric(F.col("subj"), F.col("obj"))
    return M.facts(spark, d).where("canonical = 'knows'").select("uuid", a.alias("a"), b.alias("b"))


@query("fact", f"with {_KEYED} select group_id, fact_key, count(*) as n_rows from k where invalid_at is null group by all having count(*) > 1")
def fact_key_collisions(spark, d):
    return W.collisions(_keyed(M.facts(spark, d)))


_RANKED = f"""{_KEYED}, r as (select *, count(*) over (partition by group_id, fact_key) as n_rows, row_number() over (partition by group_id, fact_key order by (status <> 'active')::int, (invalid_at is not null or expired_at is not null)::int, created_at asc nulls first, uuid) as place from k where invalid_at is null)"""


@query("fact", f"with {_RANKED} select uuid, fact_key, place from r where n_rows > 1")
def collision_winner(spark, d):
    return W.collision_ranks(_keyed(M.facts(spark, d))).select("uuid", "fact_key", "place")


@query("fact", f"""with {_RANKED}, c as (select * from r where n_rows > 1), e as (select group_id, fact_key, string_agg(distinct x, ',' order by x) as all_eps from (select group_id, fact_key, unnest(episodes) as x from c) group by all)
select uuid, case when place > 1 then c.fact_key || '::legacy-duplicate::' || uuid else c.fact_key end as fact_key, case when place > 1 then 'superseded' else status end as status, case when place > 1 then '' else coalesce(all_eps, '') end as episodes from c left join e using (group_id, fact_key)""")  # fmt: skip
def collision_merge(spark, d):
    return W.collision_merge(_keyed(M.facts(spark, d)))


@query("fact ep", """with g as (select uuid as e from ep where source = 'abandonment'), l as (select distinct uuid, unnest(episodes) as e from fact), k as (select uuid, count(*) as n from l where e not in (select e from g) group by uuid), t as (select distinct uuid from l where e in (select e from g))
select f.uuid, t.uuid is not null as touched, coalesce(k.n, 0) as n_episodes from fact f left join t using (uuid) left join k using (uuid) where t.uuid is null or k.n is not null""")  # fmt: skip
def remove_episodes(spark, d):
    gone = M.episodes(spark, d).where("source = 'abandonment'").select(F.col("uuid").alias("episode"))
    return W.remove_episodes(M.facts(spark, d), gone).withColumn("n_episodes", F.col("n_episodes").cast("long"))


# Filters


@query("fact", "select uuid from fact where (valid_at >= timestamp '2024-01-01' and valid_at < timestamp '2024-04-01') or (valid_at is null and invalid_at is not null)")
def date_dnf_filter(spark, d):
    early = P.date_dnf("valid_at", [[(">=", "2024-01-01"), ("<", "2024-04-01")]])
    none = P.date_dnf("valid_at", [[("IS NULL", None)]]) & P.date_dnf("invalid_at", [[("IS NOT NULL", None)]])
    return M.facts(spark, d).where(early | none).select("uuid")


@query("fact", "select uuid from fact where confidence > 0.9 and status = 'active' and reinforcement_count >= 2 and created_at >= timestamp '2023-06-01'")
def property_filter(spark, d):
    f = M.facts(spark, d)
    s = f.schema
    return f.where(P.property_filter(s, "confidence", ">", "0.9") & P.property_filter(s, "status", "", "active") & P.property_filter(s, "reinforcement_count", ">=", 2) & P.property_filter(s, "created_at", ">=", "2023-06-01") & P.property_filter(s, "fact", "~", "x")).select("uuid")


@query("fact", "select uuid from fact where pred in ('lives_in', 'works_at') and invalid_at is null and confidence >= 0.5")
def edge_filter(spark, d):
    f = M.facts(spark, d)
    e = P.EdgeFilter(types=["lives_in", "works_at"], dates={"invalid_at": [[("IS NULL", None)]]}, properties=[("confidence", ">=", 0.5)])
    return f.where(P.edge_passes(e, f.schema)).select("uuid")


@query("ent", "select uuid from ent where list_has_any(labels, ['Person', 'Organization'])")
def node_label_filter(spark, d):
    return M.entities(spark, d).where(P.node_passes(["Person", "Organization"])).select("uuid")


@query("fact", f"""with o as (select *, invalid_at is null and expired_at is null as open from fact)
select mode, count(*) as n_facts, min(uuid) as first_uuid from (
  select 'all' as mode, uuid from o where open union all select 'active', uuid from o where open and status = 'active' union all select 'conflicts', uuid from o where open and status = 'needs_resolution'
  union all select 'derived', uuid from o where open and source_type = 'assistant' union all select 'non_derived', uuid from o where open and source_type <> 'assistant' union all select 'invalidated', uuid from o where not open
  union all select 'at', uuid from o where {_HELD} and confidence >= 0.6) group by mode""")  # fmt: skip
def graph_filter_modes(spark, d):
    f = M.facts(spark, d)
    modes = {m: P.GraphRead(visibility=m) for m in ("all", "active", "conflicts", "derived", "non_derived", "invalidated")} | {"at": P.GraphRead(at=AT, min_confidence=0.6)}
    each = F.explode(F.filter(F.array(*[F.when(P.graph_read(p), m) for m, p in modes.items()]), lambda m: m.isNotNull()))
    return f.select(each.alias("mode"), "uuid").groupBy("mode").agg(F.count("*").alias("n_facts"), F.min("uuid").alias("first_uuid"))


@query("x", "select fact_id, memory_class from x where memory_class in ('preference', 'objective')")
def memory_class_filter(spark, d):
    x = M.extracted(spark, d)
    return x.where(P.class_is("memory_class", ["Preference", "objective"])).select("fact_id", "memory_class")


@query("fact ent", "with e as (select uuid from ent where mention_count > 20) select f.uuid from fact f where subj in (select uuid from e) or obj in (select uuid from e)")
def ego_filter(spark, d):
    f, e = M.facts(spark, d), M.entities(spark, d).where("mention_count > 20").select("uuid")
    ends = f.select(F.col("uuid").alias("fact_uuid"), F.explode(F.array("subj", "obj")).alias("uuid")).join(e, "uuid", "left_semi")
    return ends.select(F.col("fact_uuid").alias("uuid")).distinct()


# Retrieval


def _query_vector(f: DataFrame) -> list[float]:
    row = f.where(F.size("fact_embedding") == 64).where(F.forall("fact_embedding", lambda x: ~F.isnan(x)) & F.exists("fact_embedding", lambda x: x != 0)).select("uuid", "fact_embedding").orderBy("uuid").first()
    return list(row.fact_embedding) if row else [0.0] * 64


_VEC = """q as (select fact_embedding::double[] as v from fact where len(fact_embedding) = 64 and len(list_filter(fact_embedding, lambda x: isnan(x))) = 0 and len(list_filter(fact_embedding, lambda x: x <> 0)) > 0 order by uuid limit 1),
c as (select f.*, case when len(fact_embedding) <> 64 then 0.0 when list_dot_product(fact_embedding::double[], fact_embedding::double[]) = 0 then 0.0
  else list_dot_product(fact_embedding::double[], q.v) / (sqrt(list_dot_product(fact_embedding::double[], fact_embedding::double[])) * sqrt(list_dot_product(q.v, q.v))) end as cos from fact f cross join q where fact_embedding is not null),
vec as (select uuid, round(cos, 9) as score, row_number() over (order by round(cos, 9) desc, uuid) as rank from c where not isnan(cos) qualify rank <= 50)"""
_WORDS = list(dict.fromkeys(SEARCH.split()))


def _bm25_sql(table: str, key: str, column: str, words: list[str]) -> str:
    tf = "; ".join(words).split("; ")
    terms = " + ".join(f"(select ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) from st) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len(t) / (select a from st)))" for i, _ in enumerate(tf))
    counts = ", ".join(f"len(list_filter(t, lambda w: w = '{w}')) as tf{i}" for i, w in enumerate(tf))
    dfs = ", ".join(f"count(*) filter (where list_contains(t, '{w}')) as d{i}" for i, w in enumerate(tf))
    return f"tk as (select {key}, regexp_extract_all(lower(coalesce({column}, '')), '[a-z0-9]+') as t from {table}), st as (select count(*) as n, avg(len(t)) as a, {dfs} from tk), tc as (select {key}, t, {counts} from tk where list_has_any(t, {words!r})), bm as (select {key}, round({terms}, 6) as score from tc)"


_BM = _bm25_sql("fact", "uuid", "fact", _WORDS)
_LEX = "lex as (select uuid, score, row_number() over (order by score desc, uuid) as rank from bm qualify rank <= 50)"
_FUSED = "fu as (select uuid, sum(1.0 / (60 + rank)) as score, min(ordinal) as ordinal from (select uuid, rank, rank as ordinal from vec union all select uuid, rank, 1000000 + rank from lex) group by uuid)"
_HYBRID = f"{_VEC}, {_BM}, {_LEX}, {_FUSED}, hy as (select f.*, fu.score, fu.ordinal from fact f join fu using (uuid))"


def _candidates(spark, d) -> tuple[DataFrame, list[float]]:
    f = M.facts(spark, d)
    v = _query_vector(f)
    return S.hybrid(f, SEARCH, v), v


@query("fact", f"with {_VEC} select uuid, round(score, 6) as score from vec where rank <= 20")
def vector_topk(spark, d):
    f = M.facts(spark, d)
    return S.vector_topk(f, "uuid", "fact_embedding", _query_vector(f), 20).withColumn("score", F.round("score", 6))


@query("fact", f"with {_VEC}, s as (select uuid, round(cos, 9) as score from c where not isnan(cos) and pred = 'lives_in') select uuid, round(score, 6) as score from s order by s.score desc, uuid limit 10")
def vector_topk_scoped(spark, d):
    f = M.facts(spark, d)
    allowed = f.where("pred = 'lives_in'").select("uuid")
    return S.vector_topk(f, "uuid", "fact_embedding", _query_vector(f), 10, allowed).withColumn("score", F.round("score", 6))


@query("ent", """with v as (select uuid, name_embedding::double[] as v from ent where name_embedding is not null and len(list_filter(name_embedding, lambda x: isnan(x))) = 0), n as (select uuid, v, sqrt(list_dot_product(v, v)) as n from v), o as (select [1.0, -1.0]::double[] as o)
select uuid, round(case when n > 0 then (v[1] - v[2]) / (n * sqrt(2)) else 0 end, 6) as permissive, 0.0 as strict from n""")  # fmt: skip
def cosine_kinds(spark, d):
    e = M.entities(spark, d).where(F.col("name_embedding").isNotNull() & F.forall("name_embedding", lambda x: ~F.isnan(x)))
    q = V.literal([1.0, -1.0])
    return e.select("uuid", F.round(V.cosine_permissive(F.col("name_embedding"), q), 6).alias("permissive"), V.cosine_strict(F.col("name_embedding"), q).alias("strict"))


@query("fact", f"with {_BM} select uuid, score from bm")
def bm25_facts(spark, d):
    return S.bm25(M.facts(spark, d), "uuid", "fact", SEARCH)


_DOC_WORDS = ["lease", "table", "planner", "hängt"]


@query("", "with " + _bm25_sql("documents", "doc_id", "text", _DOC_WORDS[:3]) + " select doc_id, score from bm order by score desc, doc_id limit 25")
def bm25_documents(spark, d):
    return S.bm25(load(spark, d, "documents"), "doc_id", "text", " ".join(_DOC_WORDS[:3])).orderBy(F.desc("score"), "doc_id").limit(25)


@query("fact", f"with {_HYBRID} select uuid, round(score, 9) as score, ordinal from hy")
def rrf_fusion(spark, d):
    return _candidates(spark, d)[0].select("uuid", F.round("score", 9).alias("score"), "ordinal")


_VALID = "status = 'active' and (invalid_at is null or invalid_at > :NOW) and (expired_at is null or expired_at > :NOW)"


@query("fact", f"with {_HYBRID} select uuid, round(score, 9) as score, ordinal from hy where {_VALID} order by round(score, 9) desc, ordinal limit 10")
def hybrid_search(spark, d):
    c, _ = _candidates(spark, d)
    return S.top(c.where(P.still_valid(_now())), 10).select("uuid", "score", "ordinal")


_CUES = "['manages', 'pump', 'relay', 'cold', 'store']"
_HITS = f"len(list_intersect({_CUES}, list_transform(regexp_extract_all(fact || ' ' || pred || ' ' || canonical, '[A-Za-z0-9_]+(?:[.-][A-Za-z0-9_]+)*'), lambda w: lower(w))))"


@query("fact", f"with {_HYBRID}, a as (select hy.uuid, hy.fact, hy.pred, hy.canonical, c.cos from hy left join c using (uuid)) select uuid from a where coalesce(cos >= 0.25 and not isnan(cos), false) or {_HITS} >= 2")
def admission_gate(spark, d):
    c, v = _candidates(spark, d)
    return S.admit(c, SEARCH, v).select("uuid")


@query("fact", f"with {_HYBRID} select uuid, row_number() over (order by len(episodes) desc, ordinal) as rank from hy")
def rerank_mentions(spark, d):
    return S.by_mentions(_candidates(spark, d)[0]).select("uuid", "rank")


@query("fact", f"with {_HYBRID}, o as (select uuid, ordinal, round(len(list_intersect({_WORDS!r}, regexp_split_to_array(lower(fact), '\\s+'))) / {float(len(_WORDS))}, 6) as overlap from hy) select uuid, overlap, row_number() over (order by overlap desc, ordinal) as rank from o")
def rerank_cross_encoder(spark, d):
    return S.by_overlap(_candidates(spark, d)[0], SEARCH).select("uuid", "overlap", "rank")


@query()
def rerank_mmr(spark, d):
    c, v = _candidates(spark, d)
    return S.by_mmr(c, v)


_FOCAL = "fo as (select min(subj) as focal from fact)"
_BOTH = "b as (select subj as s, obj as t from fact where subj is not null and obj is not null union select obj, subj from fact where subj is not null and obj is not null)"


@query("fact", f"""with {_HYBRID}, {_FOCAL}, {_BOTH}, one as (select distinct t as node from b, fo where s = focal and t <> focal), two as (select distinct b.t as node from b join one on b.s = one.node, fo where b.t <> focal),
dp as (select node, min(depth) as depth from (select node, 1 as depth from one union all select node, 2 from two) group by node)
select hy.uuid, least(coalesce(x.depth, 99), coalesce(y.depth, 99)) as depth, row_number() over (order by least(coalesce(x.depth, 99), coalesce(y.depth, 99)), hy.score desc, ordinal) as rank from hy left join dp x on x.node = subj left join dp y on y.node = obj""")  # fmt: skip
def rerank_node_distance(spark, d):
    c, _ = _candidates(spark, d)
    f = M.facts(spark, d).where("subj is not null and obj is not null")
    focal = f.agg(F.min("subj").alias("m")).first().m or ""
    return S.by_distance(c, S.focal_depths(f.select(F.col("subj").alias("src"), F.col("obj").alias("dst")), focal)).select("uuid", "depth", "rank")


@query("fact", f"""with {_HYBRID}, i as (select distinct uuid, unnest(list_concat(['entity:' || subj, 'entity:' || obj], list_transform(episodes, lambda e: 'episode:' || e))) as ident from hy), fan as (select ident, count(*) as fan from i group by ident),
sd as (select uuid from hy order by score desc, ordinal limit 4), bo as (select i.uuid, sum(0.15 * greatest(0, 2 - ln(1 + fan))) as boost from i join i s on s.ident = i.ident and s.uuid in (select uuid from sd) and s.uuid <> i.uuid join fan on fan.ident = i.ident group by i.uuid)
select hy.uuid, round(score + coalesce(boost, 0), 6) as score from hy left join bo using (uuid)""")  # fmt: skip
def spreading_activation(spark, d):
    return S.spread(_candidates(spark, d)[0]).select("uuid", F.round("score", 6).alias("score"))


_SILENT_VEC = _VEC.replace("and len(list_filter(fact_embedding, lambda x: x <> 0)) > 0 order by", "and len(list_filter(fact_embedding, lambda x: x <> 0)) > 0 and status = 'silent' order by")


@query("fact", f"with {_SILENT_VEC}, s as (select c.uuid, round(cos, 9) as score from c where status = 'silent' and not isnan(cos) order by round(cos, 9) desc, c.uuid limit 4) select uuid, round(score, 6) as score from s where score >= 0.45 order by s.score desc, uuid limit 1")
def resurrect_silent(spark, d):
    silent = M.facts(spark, d).where("status = 'silent'")
    return S.resurrect(silent, _query_vector(silent)).withColumn("score", F.round("score", 6))


@query("fact", f"""with {_VEC}, {_BM}, lx as (select uuid, row_number() over (order by score desc, uuid) as rank from bm qualify rank <= 10), m as (select min(subj) as s, min(obj) as o from fact),
co as (select uuid, row_number() over (order by (obj <> o)::int, uuid) as rank from fact, m where obj = o or subj = s qualify rank <= 20)
select uuid, min(o) as ordinal from (select uuid, rank as o from vec where rank <= 10 union all select uuid, 1000 + rank from lx union all select uuid, 2000 + rank from co) group by uuid""")  # fmt: skip
def similar_edges(spark, d):
    f = M.facts(spark, d)
    m = f.agg(F.min("subj").alias("s"), F.min("obj").alias("o")).first()
    return S.similar_edges(f, SEARCH, _query_vector(f), m.s or "", m.o or "")


# Text


@query("fact", "select uuid, array_to_string(list_distinct_in_order, ' ') as cues from (select uuid, list_filter(l, lambda p, i: list_position(l, p) = i)[1:16] as list_distinct_in_order from (select uuid, list_transform(list_filter(regexp_extract_all(fact, '[A-Za-z0-9_]+(?:[.-][A-Za-z0-9_]+)*'), lambda r: lower(r) not in ('hi','ok','uh','um') and (not list_contains(" + repr(T.STOP) + ", lower(r)) or (length(r) <= 2 and r = upper(r) and lower(r) not in ('a','i'))) and (length(r) > 2 or (r = upper(r) and lower(r) not in ('a','i')))), lambda r: lower(r)) as l from fact))")
def cue_tokens(spark, d):
    return M.facts(spark, d).select("uuid", F.array_join(T.cue_tokens(F.col("fact")), " ").alias("cues"))


@query("fact", f"select uuid, {_HITS} as hits from fact")
def lexical_matches(spark, d):
    return M.facts(spark, d).select("uuid", T.lexical_matches(T.cue_tokens(F.lit(SEARCH)), F.col("fact"), F.col("pred"), F.col("canonical")).cast("long").alias("hits"))


@query("ent", r"""with w as (select uuid, list_filter(string_split(trim(regexp_replace(name, '[,\s]+', ' ', 'g')), ' '), lambda x: strlen(x) > 1) as w from ent),
g as (select uuid, list_concat(list_concat(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')), list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i+1], ' '))), w) as g from w),
l as (select uuid, g, list_transform(g, lambda x: lower(x)) as l from g)
select uuid, array_to_string(list_filter(g, lambda p, i: list_position(l, lower(p)) = i), '|') as grams from l""")  # fmt: skip
def query_ngrams(spark, d):
    return M.entities(spark, d).select("uuid", F.array_join(T.query_ngrams(F.col("name")), "|").alias("grams"))


@query("al", r"select uuid, trim(regexp_replace(regexp_replace(lower(alias), '[^\p{L}\p{N}_\s''-]', ' ', 'g'), '\s+', ' ', 'g')) as normalized from al")
def normalize_alias(spark, d):
    return M.aliases(spark, d).select("uuid", T.normalize_alias(F.col("alias")).alias("normalized"))


@query("ent", "select uuid, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown') as snake from ent")
def snake_case(spark, d):
    return M.entities(spark, d).select("uuid", T.snake_case(F.col("name")).alias("snake"))


_PATTERN = r"""pr as (select *, lag(content) over (partition by group_id order by created_at, uuid) as prior from ep),
m as (select *, length(content) - length(replace(content, '?', '')) as qs, len(list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> '')) as words,
  len(list_intersect(list_filter(regexp_extract_all(lower(content), '[a-zA-Z'']+'), lambda w: length(w) > 3), list_filter(regexp_extract_all(lower(coalesce(prior, '')), '[a-zA-Z'']+'), lambda w: length(w) > 3))) as overlap from pr),
pt as (select uuid, group_id, created_at, case when content = '' then 'one_off_query' when regexp_matches(content, '(?i)\b(?:best|optimal|optimi[sz]e|improve|better|tune|refine|tweak|sharper|tighter)\b') then 'optimization_request'
  when qs = 0 and words >= 60 then 'narrative_share' when coalesce(prior, '') <> '' and overlap >= 3 and qs >= 1 then 'iterative_refinement' when coalesce(prior, '') <> '' and overlap >= 2 and words < 40 then 'clarification' else 'one_off_query' end as pattern from m)"""


@query("ep", f"with {_PATTERN} select uuid, pattern from pt")
def interaction_patterns(spark, d):
    return C.interaction_patterns(M.episodes(spark, d)).select("uuid", "pattern")


@query("ep", f"""with {_PATTERN}, r as (select * from pt qualify row_number() over (partition by group_id order by created_at desc, uuid desc) <= 8), n as (select group_id, pattern, count(*) as hits from r group by all),
t as (select * from n qualify row_number() over (partition by group_id order by hits desc, pattern) = 1) select group_id, pattern, hits, round(least(1.0, 0.5 + 0.06 * hits), 2) as confidence from t where hits >= 5 and pattern <> 'one_off_query'""")  # fmt: skip
def dominant_patterns(spark, d):
    return C.dominant_patterns(C.interaction_patterns(M.episodes(spark, d)))


@query()
def evidence_snippets(spark, d):
    q = T.cue_tokens(F.lit("lease table planner"))
    docs = load(spark, d, "documents").select("doc_id", F.explode(T.evidence_snippets(F.col("text"), q)).alias("snippet"))
    return docs


@query()
def dummy_embeddings(spark, d):
    return M.entities(spark, d).select("uuid", V.dummy_embedding("name").alias("v"))


# Strength of memories

_AGE = "greatest((epoch_us(:NOW) - epoch_us(coalesce(valid_at, created_at))) / 3.6e9, 0.01)"
_STRONG = f"""l as (select *, (reinforcement_count + recall_count * 0.15) * pow({_AGE}, -0.5) as s from fact), lv as (select *, case when s > 0 then ln(s) else -10 end as level from l),
st as (select *, case when stability = 'consolidated' then 1.0 else 1 / (1 + exp(-(level + 3.5) / 0.8)) end as alive from lv), sf as (select *, least(greatest(least(greatest(confidence, 0), 1) * alive, 0), 1) as effective from st)"""


def _strong(spark, d) -> DataFrame:
    return C.strength(M.facts(spark, d), _now())


@query("fact", f"with {_STRONG} select uuid, round(level, 6) as level, round(alive, 6) as alive, round(effective, 6) as effective from sf")
def effective_confidence(spark, d):
    return _strong(spark, d).select("uuid", F.round("level", 6).alias("level"), F.round("alive", 6).alias("alive"), F.round("effective", 6).alias("effective"))


@query("fact", "select uuid, round(least(greatest(confidence - floor(greatest((epoch_us(:NOW) - epoch_us(coalesce(valid_at, created_at))) / 3.6e9 / 24, 0)) * 0.01, 0), 1), 6) as vitality, case stability when 'episodic' then 30 when 'reinforced' then 90 when 'persistent' then 365 end as half_life from fact where stability <> 'consolidated'")
def linear_vitality(spark, d):
    f = M.facts(spark, d).where("stability != 'consolidated'")
    return f.select("uuid", F.round(D.linear_vitality(F.col("confidence"), F.coalesce("valid_at", "created_at"), _now(), D.protected(F.col("stability"))), 6).alias("vitality"), D.half_life(F.col("stability")).alias("half_life"))


@query("", """with e as (select user_id, event_type, ts, case when event_type = 'view' then 0.15 else 1.0 end as w from events where ts is not null), n as (select *, row_number() over (partition by user_id, event_type order by ts desc, w desc) as n from e),
g as (select user_id, event_type, sum(w) as total, min(ts) as created, count(*) as n_events from e group by all),
x as (select user_id, event_type, count(*) as n_exact, sum(w) as exact, min(ts) as first, sum(w * pow(greatest((epoch_us(timestamp '2024-03-01') - epoch_us(ts)) / 3.6e9, 0.01), -0.5)) as s from n where n <= 8 group by all),
a as (select *, greatest(total - exact, 0) as older, greatest((epoch_us(timestamp '2024-03-01') - epoch_us(created)) / 3.6e9, 0.01) as life, greatest((epoch_us(timestamp '2024-03-01') - epoch_us(first)) / 3.6e9, 0.01) as old from g join x using (user_id, event_type)),
b as (select *, ln(s + case when older > 0 then older * case when life > old + 1e-9 then (sqrt(life) - sqrt(old)) / (0.5 * (life - old)) else pow(life, -0.5) end else 0 end) as lvl from a)
select user_id, event_type, n_events, n_exact, round(total, 6) as total_weight, round(lvl, 6) as level, round(1 / (1 + exp(-(lvl + 3.5) / 0.8)), 6) as vitality from b""")  # fmt: skip
def bounded_activation(spark, d):
    w = F.when(F.col("event_type") == "view", D.RECALL_WEIGHT).otherwise(D.REINFORCE_WEIGHT)
    out = C.bounded_activation(load(spark, d, "events"), ["user_id", "event_type"], "ts", w, P.instant("2024-03-01"))
    return out.withColumn("n_exact", F.col("n_exact").cast("long"))


@query("fact", f"""with {_STRONG}, lf as (select * from sf where status = 'active'), t1 as (select uuid, unnest([subj, obj]) as id from lf), t2 as (select uuid, unnest(episodes) as id from lf),
n1 as (select t1.uuid, sum(n) as n from t1 join (select id, count(*) as n from t1 where id is not null group by id) using (id) group by t1.uuid), n2 as (select t2.uuid, sum(n) as n from t2 join (select id, count(*) as n from t2 group by id) using (id) group by t2.uuid),
tt as (select uuid, sum(n) as touched from (select * from n1 union all select * from n2) group by uuid)
select lf.uuid, coalesce(touched, 0)::bigint as touched, round(least(greatest(effective * (1 + least(1, coalesce(touched, 0) / 12)), 0), 4), 6) as weight from lf left join tt using (uuid)""")  # fmt: skip
def associative_weights(spark, d):
    return C.associative_weights(_strong(spark, d))


@query("fact", f"with {_STRONG}, o as (select * from sf where status = 'active' and (epoch_us(:NOW) - epoch_us(created_at)) / 3.6e9 / 24 > 30 qualify row_number() over (partition by group_id order by created_at, uuid) <= 500) select uuid, round(level, 6) as level from o where stability <> 'consolidated' and level < -3.5")
def silence_inactive(spark, d):
    return C.silence(_strong(spark, d), _now())


@query("fact ep", """with j as (select distinct f.uuid, f.stability, e.uuid as eu, e.created_at from (select uuid, stability, unnest(episodes) as e from fact) f join ep e on e.uuid = f.e), g as (select uuid, stability, count(*) as n, (epoch_us(max(created_at)) - epoch_us(min(created_at))) / 8.64e10 as days from j group by all)
select uuid, n as n_episodes, round(days, 6) as span_days, case when stability = 'consolidated' then stability when n >= 7 and days >= 7 then 'persistent' when n >= 3 and stability = 'episodic' then 'reinforced' else stability end as stability from g""")  # fmt: skip
def reinforcement(spark, d):
    return C.reinforcement(M.facts(spark, d), M.episodes(spark, d))


@query("fact", """with v as (select * from fact where canonical not in ('has_trait', 'pursues_goal', 'is_age', 'has_birthday', 'has_age', 'is_a', 'is_named', 'is_called', 'is_self', 'is_aka', 'mentions_with') and canonical <> '' and not singleton and status = 'active'),
o as (select group_id, subj, canonical, obj, sum(greatest(reinforcement_count, 1)) as strength, 0 as kind from v group by all having sum(greatest(reinforcement_count, 1)) >= 2),
r as (select group_id, subj, canonical, '*' as obj, sum(greatest(reinforcement_count, 1)) as strength, 1 as kind from v group by group_id, subj, canonical having count(*) >= 3), u as (select * from o union all select * from r)
select group_id, subj, canonical, obj, strength::bigint as strength, row_number() over (partition by group_id, subj order by strength desc, kind, canonical, obj) as place from u qualify place <= 12""")  # fmt: skip
def trait_candidates(spark, d):
    return C.trait_candidates(M.facts(spark, d))


@query("fact ep", f"""with {_KEYED}, v as (select * from k where status = 'active' and stability <> 'consolidated' and fact_key <> ''), t as (select distinct group_id, fact_key, unnest(episodes) as e from v),
j as (select t.*, ep.created_at as seen_at from t left join ep on ep.uuid = t.e), s as (select group_id, fact_key, count(*) as n_episodes, count(seen_at) as n_timed, (epoch_us(max(seen_at)) - epoch_us(min(seen_at))) / 8.64e10 as days from j group by all),
m as (select group_id, fact_key, avg(confidence) as mean, count(*) as n_facts from v group by all), c as (select group_id, fact_key, uuid as clearest from v qualify row_number() over (partition by group_id, fact_key order by confidence desc, uuid) = 1)
select group_id, fact_key, n_facts, n_episodes, round(least(1.0, mean + 0.1), 6) as confidence, clearest from s join m using (group_id, fact_key) join c using (group_id, fact_key) where n_episodes >= 8 and n_timed >= 2 and days >= 14""")  # fmt: skip
def consolidation(spark, d):
    return C.consolidation(_keyed(M.facts(spark, d)), M.episodes(spark, d))


#: Seven facts without any confidence, as no test table has some.
_FADED = """select 'faded-' || {0} as uuid, 'faded' as group_id, 'faded-subject' as subj, 'faded-object' as obj, 'owns' as pred, 'owns' as canonical, case when {0} = 3 then '' else 'Faded fact ' || {0} || '.' end as fact, 'active' as status, 'episodic' as stability,
  cast(0 as double) as confidence, cast('2020-01-0' || ({0} + 1) as timestamp) as created_at, cast(null as timestamp) as valid_at, cast(1 as bigint) as reinforcement_count, cast(0 as bigint) as recall_count"""


@query("fact", f"""with pl as (select * from fact union all by name {_FADED.format('i')} from range(7) r(i)), {_STRONG.replace('from fact)', 'from pl)')}, w as (select *, 'objective' as memory_class, case when canonical <> '' then canonical when pred <> '' then pred else 'misc' end as bucket,
  case when trim(fact) <> '' then trim(fact) when pred <> '' then pred end as said from (select * from sf where status = 'active' and stability <> 'consolidated' qualify row_number() over (partition by group_id order by created_at, uuid) <= 120) where effective <= 0),
g as (select group_id, subj, memory_class, bucket, count(*) as n_facts, list(said order by created_at, uuid) filter (where said is not null) as l from w group by all having count(*) >= 5)
select group_id, subj, memory_class, bucket, n_facts, 'Low-vitality memory cluster' || case when l is null then '.' else ': ' || array_to_string(l[1:5], '; ') || case when len(l) > 5 then '; and ' || (len(l) - 5) || ' related older facts' else '' end end as summary from g""")  # fmt: skip
def stagnant_consolidation(spark, d):
    f = M.facts(spark, d).unionByName(spark.sql(_FADED.format("id") + " from range(7)"), allowMissingColumns=True)
    f = f.withColumn("memory_class", F.coalesce("memory_class", F.lit("objective"))).withColumn("domain", F.coalesce("domain", F.lit("")))
    return C.stagnant(C.strength(f, _now()))


@query("fact", """with k as (select group_id, created_at, uuid, regexp_extract_all(lower(fact), '[a-z]{4,}') as l from fact), w as (select group_id, created_at, uuid, unnest(l) as term, generate_subscripts(l, 1) as pos from k),
v as (select * from w where term not in ('have', 'with', 'this', 'that', 'from', 'user', 'also', 'into', 'their', 'there', 'about', 'they', 'your', 'more', 'much', 'some', 'what', 'when', 'would', 'could', 'should', 'really', 'actually')),
f as (select *, row_number() over (partition by group_id order by created_at nulls first, uuid, pos) as place_at from v), n as (select group_id, term, count(*) as n, min(place_at) as first_at from f group by all)
select group_id, term, n, row_number() over (partition by group_id order by n desc, first_at) as place from n qualify place <= 5""")  # fmt: skip
def top_terms(spark, d):
    return C.top_terms(M.facts(spark, d))


#: Texts with emotional words, as the test tables have few.
_MOODS = "(values ('mood-1', 'I was frustrated and stuck, then excited about it.'), ('mood-2', 'Maybe happy, maybe unsure. Urgent!'), ('mood-3', 'love hate'), ('mood-4', 'So tired; exhausted. ASAP deadline, asap'), ('mood-5', 'nothing of the kind'))"


@query("ep", f"""with lx(word, emotion, polarity, weight) as (values ('frustrated', 'frustration', -0.7::double, 1.0::double), ('annoyed', 'frustration', -0.5, 0.8), ('angry', 'frustration', -0.8, 1), ('stuck', 'frustration', -0.5, 0.7), ('hate', 'frustration', -0.7, 0.8),
  ('tired', 'fatigue', -0.4, 0.6), ('exhausted', 'fatigue', -0.7, 0.9), ('sad', 'sadness', -0.6, 0.8), ('worried', 'anxiety', -0.5, 0.7), ('anxious', 'anxiety', -0.6, 0.8), ('nervous', 'anxiety', -0.4, 0.6), ('embarrassed', 'embarrassment', -0.5, 0.7),
  ('excited', 'excitement', 0.7, 0.9), ('love', 'excitement', 0.7, 0.9), ('happy', 'joy', 0.7, 0.9), ('great', 'joy', 0.4, 0.5), ('awesome', 'excitement', 0.7, 0.8), ('amazing', 'excitement', 0.7, 0.8), ('proud', 'pride', 0.7, 0.9), ('confident', 'confidence', 0.6, 0.8), ('winning', 'excitement', 0.6, 0.7),
  ('urgent', 'urgency', 0, 0.9), ('asap', 'urgency', 0, 0.9), ('deadline', 'urgency', -0.2, 0.8), ('confused', 'uncertainty', -0.3, 0.7), ('unsure', 'uncertainty', -0.2, 0.6), ('maybe', 'uncertainty', -0.1, 0.4)),
k as (select uuid, regexp_extract_all(lower(content), '[a-z'']+') as l from (select uuid, content from ep union all select * from {_MOODS} m(uuid, content))), w as (select uuid, unnest(l) as word, generate_subscripts(l, 1) as pos from k),
p as (select uuid, emotion, sum(weight) as w, min(pos) as first, sum(polarity * weight) as pw from w join lx using (word) group by all)
select uuid, emotion, round(pw / greatest(1e-6, w), 3) as polarity, round(least(1.0, w / 2), 3) as intensity from p qualify row_number() over (partition by uuid order by round(w, 9) desc, first) = 1""")  # fmt: skip
def affect_scores(spark, d):
    e = M.episodes(spark, d).select("uuid", "content").unionByName(spark.sql(f"select * from {_MOODS} as m(uuid, content)"))
    return C.affect(e, C.lexicon(e))


@query("", """with o as (select user_id, ts, event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) > 21600000000, true)::int as new from events), s as (select *, sum(new) over (partition by user_id order by ts, event_id) as session from o),
n as (select *, row_number() over (partition by user_id, session order by ts, event_id) as n from s) select user_id, session::bigint as session, ((n - 1) // 5)::bigint as batch, count(*) as n_events, min(event_id) as first_id from n group by all""")  # fmt: skip
def debounce_batches(spark, d):
    return C.debounce(load(spark, d, "events"), "user_id", "ts", "event_id", 21600, 5)


# Resolution


#: Whether key k is one of the phrases of up to three words of the query q.k.
_GRAM = "k in (select array_to_string(w[i:i + n - 1], ' ') from (select string_split(q.k, ' ') as w), range(1, 10) r(i), (values (1), (2), (3)) t(n) where i + n - 1 <= len(w))"
_NORM = r"trim(regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_\s''-]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("ent al x", f"""with m as (select distinct group_id, subject as mention, {_NORM.format('subject')} as k from x where subject <> ''), e as (select group_id, uuid, {_NORM.format('name')} as k from ent),
a as (select al.group_id, {_NORM.format('coalesce(normalized_alias, alias)')} as k, entity_uuid, confidence from al join e on e.uuid = al.entity_uuid and e.group_id = al.group_id), a1 as (select * from a qualify row_number() over (partition by group_id, k order by confidence desc, entity_uuid) = 1), n as (select group_id, k, min(uuid) as uuid from e group by all)
select m.group_id, mention, coalesce(a1.entity_uuid, n.uuid) as entity_uuid, case when a1.entity_uuid is not null then 'alias_hit' when n.uuid is not null then 'exact_name' else 'new' end as how from m left join a1 on a1.group_id = m.group_id and a1.k = m.k left join n on n.group_id = m.group_id and n.k = m.k""")  # fmt: skip
def entity_resolution_alias(spark, d):
    m = M.extracted(spark, d).where("subject != ''").select("group_id", F.col("subject").alias("mention")).distinct()
    return R.resolve_names(m, M.aliases(spark, d), M.entities(spark, d))


@query("ent", """with v as (select uuid, group_id, name, name_embedding::double[] as v, array_to_string(list_sort(regexp_extract_all(name, '\\d+')), ',') as numbers from ent where name_embedding is not null and len(list_filter(name_embedding, lambda x: isnan(x))) = 0),
n as (select *, sqrt(list_dot_product(v, v)) as n from v), m as (select group_id, name as mention, min_by(v, uuid) as v, any_value(numbers) as numbers from n where len(v) = 64 group by group_id, name), mm as (select *, sqrt(list_dot_product(v, v)) as n from m),
s as (select mm.group_id, mention, n.uuid, round(case when len(n.v) <> 64 or n.n = 0 or mm.n = 0 then 0 else list_dot_product(case when len(n.v) = 64 then n.v else mm.v end, mm.v) / (n.n * mm.n) end, 6) as score from mm join n on n.group_id = mm.group_id and n.numbers = mm.numbers),
r as (select *, lead(score) over w as nxt, row_number() over w as no from s where score >= 0.86 window w as (partition by group_id, mention order by score desc, uuid)) select group_id, mention, uuid as entity_uuid, score, (nxt is null or round(score - nxt, 6) >= 0.05) as clear from r where no = 1""")  # fmt: skip
def entity_resolution_semantic(spark, d):
    e = M.entities(spark, d).where(F.col("name_embedding").isNotNull() & F.forall("name_embedding", lambda x: ~F.isnan(x)))
    m = e.where(F.size("name_embedding") == 64).groupBy("group_id", F.col("name").alias("mention")).agg(F.min_by("name_embedding", "uuid").alias("vector"))
    return R.resolve_semantic(m, e)


@query("ent", r"with k as (select *, first_value(uuid) over (partition by group_id, lower(trim(regexp_replace(name, '\s+', ' ', 'g'))) order by created_at, uuid) as kept from ent) select uuid, kept as kept_uuid from k where uuid <> kept")
def case_merge(spark, d):
    return R.case_merge(M.entities(spark, d))


@query("fact", """with p as (select distinct group_id, pred from fact), k as (select coalesce(group_id, '') as fg, canonical_name, cardinality, unnest(list_concat([canonical_name], coalesce(aliases, []))) as k from relation_frame where canonical_name is not null),
j as (select p.group_id, p.pred, k.canonical_name, k.cardinality, row_number() over (partition by p.group_id, p.pred order by (fg = '')::int, (lower(trim(k)) <> lower(canonical_name))::int, canonical_name) as n from p left join k on lower(trim(k.k)) = p.pred and (fg = '' or fg = p.group_id))
select group_id, pred as predicate, coalesce(canonical_name, pred) as canonical, coalesce(cardinality, 'unknown') as cardinality from j where n = 1""")  # fmt: skip
def frame_resolution(spark, d):
    return R.resolve_frames(M.facts(spark, d).select("group_id", F.col("pred").alias("predicate")).distinct(), M.frames(spark, d))


@query("x", "with c as (select canonical_name, min(cardinality) as cardinality from relation_frame where coalesce(group_id, '') = '' group by 1) select fact_id, operation, case when operation = 'correct' then true when operation = 'qualify' then false when canonical_name is not null then coalesce(cardinality in ('one', 'one_current'), false) else singleton end as closes from x left join c on canonical_name = predicate")
def fact_operations(spark, d):
    c = M.frames(spark, d).where("coalesce(group_id, '') = ''").groupBy(F.col("canonical_name").alias("predicate")).agg(F.coalesce(F.min("cardinality"), F.lit("unknown")).alias("cardinality"))
    return M.extracted(spark, d).join(c, "predicate", "left").select("fact_id", "operation", R.singleton_decision(F.col("operation"), F.col("cardinality"), F.col("singleton"), F.lit(True)).alias("closes"))


@query("x", f"select fact_id, case when lower(subject) = lower(object_name) then 'speaker' else subject end as subject, predicate, object_name from x where subject <> '' and predicate <> '' and object_name <> '' and not (predicate in {R.PLACES!r} and lower(object_name) in {R.FILLERS!r}) and (lower(subject) <> lower(object_name) or predicate in {R.IDENTITY!r})")
def repair_facts(spark, d):
    return R.repair(M.extracted(spark, d), F.lit("speaker")).select("fact_id", "subject", "predicate", "object_name")


@query("fact ent", """with t as (select uuid, case when list_contains(labels, 'Person') then 'Person' when list_contains(labels, 'Organization') then 'Organization' else 'Other' end as kind from ent)
select f.uuid from fact f join t s on s.uuid = f.subj join t o on o.uuid = f.obj where (s.kind = 'Person' and o.kind = 'Organization' and f.pred in ('works_at', 'member_of', 'insured_by')) or (s.kind = 'Organization' and o.kind = 'Other')""")  # fmt: skip
def edge_type_map(spark, d):
    e = M.entities(spark, d).select("uuid", F.when(F.array_contains("labels", "Person"), "Person").when(F.array_contains("labels", "Organization"), "Organization").otherwise("Other").alias("kind"))
    f = M.facts(spark, d).join(e.select(F.col("uuid").alias("subj"), F.col("kind").alias("subj_type")), "subj").join(e.select(F.col("uuid").alias("obj"), F.col("kind").alias("obj_type")), "obj")
    rules = spark.createDataFrame([("Person", "Organization", ["works_at", "member_of", "insured_by"]), ("Organization", "Other", [])], "subj_type string, obj_type string, predicates array<string>")
    return R.allowed_by_types(f, rules).select("uuid")


# Graph


@query("fact", "with m as (select uuid, unnest(episodes) as episode, subj, obj from fact), l as (select uuid, episode, subj as entity from m union all select uuid, episode, obj from m) select episode, entity, count(*) as n_mentions, min(uuid) as first_fact from l where entity is not null group by all")
def mention_aggregate(spark, d):
    return G.mention_aggregate(G.mentions(M.facts(spark, d)))


@query("fact ent", "with k as (select * from fact where invalid_at is null and subj in (select uuid from ent) and obj in (select uuid from ent)) select node, count(*) as degree from (select subj as node from k union all select obj from k) group by node")
def node_degree(spark, d):
    return G.degree(G.links(M.facts(spark, d).where("invalid_at is null"), M.entities(spark, d)))


@query("fact ent", "select f.uuid from fact f where subj in (select uuid from ent) and obj in (select uuid from ent)")
def graph_links(spark, d):
    return G.links(M.facts(spark, d), M.entities(spark, d)).select("uuid")


@query("fact", f"""with {_FOCAL}, {_BOTH}, one as (select distinct t as node from b, fo where s = focal), two as (select distinct b.t as node from b join one on b.s = one.node)
select node, min(hop)::int as hop from (select focal as node, 0 as hop from fo union all select node, 1 from one union all select node, 2 from two) group by node""")  # fmt: skip
def ego_network(spark, d):
    f = M.facts(spark, d)
    return G.ego(f, f.agg(F.min("subj").alias("m")).first().m or "")


_COMM = """o as (select group_id, subj as a, obj as b from fact where invalid_at is null and subj is not null and obj is not null and subj <> obj), bw as (select group_id, a, b from o union select group_id, b, a from o),
re(group_id, node, other) as (select group_id, a, a from bw union select r.group_id, r.node, w.b from re r join bw w on w.group_id = r.group_id and w.a = r.other), cm as (select group_id, node, min(other) as community from re group by all)"""


@query("fact", f"with {_COMM} select group_id, node, community from cm".replace("with o", "with o"))
def communities(spark, d):
    return G.communities(M.facts(spark, d))


@query("fact ent", f"""with {_COMM}, dg as (select node, count(*) as degree from (select subj as node from fact where invalid_at is null and subj <> obj union all select obj from fact where invalid_at is null and subj <> obj) where node is not null group by node),
r as (select cm.*, coalesce(e.name, '') as name, row_number() over (partition by cm.group_id, community order by degree desc, cm.node) as n, count(*) over (partition by cm.group_id, community) as n_members from cm left join dg using (node) left join ent e on e.uuid = cm.node)
select group_id, community, n_members, node as head, name as head_name from r where n = 1""")  # fmt: skip
def community_report(spark, d):
    f = M.facts(spark, d)
    return G.community_report(G.communities(f), f, M.entities(spark, d))


for _name in ("communities", "community_report"):
    ORACLE[_name] = ORACLE[_name].replace("with ", "with recursive ", 1)


@query("fact ent", """with c as (select canonical_name, min(temporal_kind) as temporal_kind, min(cardinality) as cardinality from relation_frame where coalesce(group_id, '') = '' group by 1)
select f.uuid, s.name as subj_name, o.name as obj_name, f.canonical, c.temporal_kind, c.cardinality from fact f left join ent s on s.uuid = f.subj left join ent o on o.uuid = f.obj left join c on c.canonical_name = f.canonical""")  # fmt: skip
def explain_fact(spark, d):
    return G.explain(M.facts(spark, d), M.entities(spark, d), M.frames(spark, d))


@query("fact ep", "with l as (select distinct uuid, unnest(episodes) as e from fact), r as (select l.uuid, l.e as episode, row_number() over (partition by l.uuid order by created_at desc, l.e) as place, content from l join ep on ep.uuid = l.e) select uuid, episode, place, left(content, 500) as preview from r where place <= 20")
def fact_sources(spark, d):
    return G.sources(M.facts(spark, d), M.episodes(spark, d))


@query("fact ent", f"""with v as (select * from fact where {_LIVE}), t as (select subj as uuid, fact, uuid as fu, coalesce(valid_at, created_at) as tm from v union all select obj, fact, uuid, coalesce(valid_at, created_at) from v where subj <> obj),
n as (select * from (select *, row_number() over (partition by uuid order by tm desc, fu) as n from t) where n <= 30), g as (select uuid, count(*) as n_facts from n group by uuid) select e.uuid, n_facts from g join ent e using (uuid)""")  # fmt: skip
def entity_profile_facts(spark, d):
    return G.entity_profiles(M.facts(spark, d), M.entities(spark, d), _now()).select("uuid", "n_facts")


@query()
def entity_profile(spark, d):
    return G.entity_profiles(M.facts(spark, d), M.entities(spark, d), _now())


@query("fact ent", "select uuid, group_id from ent where uuid not in (select subj from fact where subj is not null union select obj from fact where obj is not null)")
def orphan_entities(spark, d):
    return G.orphan_entities(M.entities(spark, d), M.facts(spark, d))


@query("fact ep", "select uuid, group_id from ep where uuid not in (select unnest(episodes) from fact)")
def orphan_episodes(spark, d):
    return G.orphan_episodes(M.episodes(spark, d), M.facts(spark, d))


@query("ent", "select group_id, canonical_name, count(*) as n_entities, min(uuid) as first_uuid from ent where coalesce(canonical_name, '') <> '' group by all having count(*) > 1")
def duplicate_candidates(spark, d):
    return G.duplicate_candidates(M.entities(spark, d))


@query("fact", "select kind, value, count(*) as n_facts from (select 'status' as kind, status as value from fact union all select 'source_type', source_type from fact union all select 'memory_class', 'objective' from fact) group by all")
def inspect_counts(spark, d):
    return G.inspect_counts(M.facts(spark, d))


@query("fact ent ep", """with g as (select coalesce(group_id, '') as group_id, * exclude group_id from fact), e as (select coalesce(group_id, '') as group_id, * exclude group_id from ep)
select group_id, 'facts_without_source_episodes' as check, count(*) as n from g where len(episodes) = 0 group by all
union all select group_id, 'low_confidence_facts', count(*) from g where confidence < 0.5 group by all
union all select group_id, 'open_active_facts', count(*) from g where invalid_at is null and expired_at is null and status = 'active' and valid_at is not null group by all
union all select group_id, 'total_relates_to', count(*) from g group by all
union all select group_id, 'cognition_backlog_unprocessed', count(*) from e where cognition_processed_at is null group by all
union all select group_id, 'total_episode', count(*) from e group by all
union all select coalesce(group_id, ''), 'total_entity', count(*) from ent group by all
union all select coalesce(group_id, ''), 'total_relation_frame', count(*) from relation_frame where canonical_name is not null group by all""".replace(" as check", ' as "check"'))  # fmt: skip
def inspection(spark, d):
    return G.inspection(M.facts(spark, d), M.entities(spark, d), M.episodes(spark, d), M.frames(spark, d))


@query("fact", "select uuid, confidence from fact where confidence < 0.5")
def low_confidence(spark, d):
    return M.facts(spark, d).where("confidence < 0.5").select("uuid", "confidence")


@query("fact ent", "with e as (select * from fact where invalid_at is null and expired_at is null and status = 'active' and subj in (select uuid from ent) and obj in (select uuid from ent) order by created_at, uuid limit 1500) select uuid, subj, obj from e")
def read_graph(spark, d):
    return G.read_graph(M.facts(spark, d), M.entities(spark, d), "truth")[1].select("uuid", "subj", "obj")


# Episodes


@query("ep", "select group_id, uuid, row_number() over (partition by group_id order by created_at desc, uuid) as place from ep where created_at <= :AT qualify place <= 10")
def retrieve_episodes(spark, d):
    at = Window.partitionBy("group_id").orderBy(F.desc("created_at"), "uuid")
    return M.episodes(spark, d).where(F.col("created_at") <= _at()).withColumn("place", F.row_number().over(at)).where("place <= 10").select("group_id", "uuid", "place")


@query("ep", r"with l as (select *, row_number() over (partition by group_id order by created_at desc, uuid) as n from ep where created_at <= :AT qualify n <= 10), t as (select group_id, regexp_replace(content, '^\s+|\s+$', '', 'g') as c, n from l) select group_id, string_agg(c, chr(10) || '---' || chr(10) order by n desc) as context from t where c <> '' group by group_id")
def episode_context(spark, d):
    at = Window.partitionBy("group_id").orderBy(F.desc("created_at"), "uuid")
    last = M.episodes(spark, d).where(F.col("created_at") <= _at()).withColumn("n", F.row_number().over(at)).where("n <= 10").withColumn("c", F.regexp_replace("content", r"^\s+|\s+$", "")).where("c != ''")
    return last.groupBy("group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "c"))), lambda x: x["c"]), "\n---\n").alias("context"))


@query("ep", "select uuid, group_id from ep where ingestion_complete and cognition_processed_at is null")
def unprocessed_episodes(spark, d):
    return M.episodes(spark, d).where("ingestion_complete and cognition_processed_at is null").select("uuid", "group_id")


@query("ep", r"select uuid, array_to_string(list_filter(l, lambda p, i: list_position(l, p) = i), '|') as phrases from (select uuid, regexp_extract_all(content, '\b[A-Z][a-z0-9]+(?: [A-Z][a-z0-9]+)*\b') as l from ep)")
def extract_phrases(spark, d):
    return M.episodes(spark, d).select("uuid", F.array_join(extract.phrases(F.col("content")), "|").alias("phrases"))


@query("fact ent al", f"""with q as (select {_NORM.format('name')} as k from ent where name <> '' order by mention_count desc, uuid limit 1), eg as (select distinct uuid from (select uuid, {_NORM.format('name')} as k from ent union all select entity_uuid, {_NORM.format('alias')} from al where entity_uuid is not null) z, q where {_GRAM.replace('k in', 'z.k in', 1)}),
st as (select *, row_number() over (partition by subj, canonical, obj order by valid_at desc nulls last, uuid) as n from fact where {_HELD}) select uuid from st where n = 1 and (subj in (select uuid from eg) or obj in (select uuid from eg)) order by valid_at desc nulls last, uuid limit 20""")  # fmt: skip
def recall_as_of(spark, d):
    g = MemoryGraph.load(spark, d)
    row = g.entities.where("name != ''").orderBy(F.desc("mention_count"), "uuid").select("name").first()
    return g.recall_as_of(row.name if row else "", AT).select("uuid")


# Participants and packs

_REFS = "rf as (select distinct group_id, uuid as fact_uuid, actor, case when actor = subj then 'asserted' else 'witnessed' end as role from (select group_id, uuid, subj, unnest([subj, obj]) as actor from fact) where actor is not null)"


def _refs(f: DataFrame) -> DataFrame:
    return N.write_refs(f, F.col("subj"), F.array("obj"))


@query("fact", f"with {_REFS} select actor, fact_uuid, string_agg(distinct role, ',' order by role) as roles from rf group by all")
def participant_visible(spark, d):
    f = M.facts(spark, d)
    return N.visible(f, _refs(f)).select("actor", "fact_uuid", "roles")


@query("fact", f"with {_REFS} select role, count(*) as n_refs, count(distinct actor) as n_actors from rf group by role")
def participant_roles(spark, d):
    return _refs(M.facts(spark, d)).groupBy("role").agg(F.count("*").alias("n_refs"), F.count_distinct("actor").alias("n_actors"))


@query("fact", f"with {_REFS}, m as (select max(subj) as r from fact) select group_id, r as actor, fact_uuid from rf, m where role = 'asserted' and actor in (select min(subj) from fact)")
def grants(spark, d):
    f = M.facts(spark, d)
    m = f.agg(F.min("subj").alias("g"), F.max("subj").alias("r")).first()
    refs = _refs(f)
    wanted = f.select(F.lit(m.g).alias("giver"), F.lit(m.r).alias("receiver"), F.col("uuid").alias("fact_uuid"))
    return N.grant(refs, wanted, _now()).select("group_id", "actor", "fact_uuid")


@query("fact", f"with {_REFS} select actor, count(*) as n_open from rf where not (actor in (select min(subj) from fact) and role = 'asserted') group by actor")
def forget(spark, d):
    f = M.facts(spark, d)
    who = f.agg(F.min("subj").alias("m")).first().m or ""
    return N.close(_refs(f), (F.col("actor") == who) & (F.col("role") == "asserted"), _now()).where("invalid_at is null").groupBy("actor").agg(F.count("*").alias("n_open"))


@query("fact", "select uuid, pred, len(episodes) as episode_count, len(episodes) > 0 as episodes_omitted from fact")
def pack_export_rows(spark, d):
    return packs.export_rows(M.facts(spark, d)).select("uuid", "pred", F.col("episode_count").cast("long").alias("episode_count"), "episodes_omitted")


@query()
def pack_import_remap(spark, d):
    e = M.entities(spark, d)
    return packs.remap_entities(e.where("group_id != 'ws-main'"), e, "ws-main")


# Read models


_EPS = "eps as (select uuid, group_id, trim(source_description) as resource from (select *, row_number() over (partition by uuid order by created_at, content asc nulls last) as rn from episode where uuid is not null) where rn = 1 and source_description is not null and trim(source_description) <> '')"


@query("", f"with {_EPS} select group_id, resource, count(*) as n_episodes, min(uuid) as first_uuid from eps group by all")
def resources(spark, d):
    return X.resources(M.episodes(spark, d))


@query("fact", f"with {_EPS}, l as (select distinct uuid as fact, unnest(episodes) as episode, subj, obj from fact), j as (select group_id, resource, fact, unnest([subj, obj]) as node from eps join l on l.episode = eps.uuid) select group_id, resource, count(distinct fact) as n_facts, count(distinct node) as n_nodes from j where node is not null group by all")
def resource_support(spark, d):
    return X.resource_support(M.episodes(spark, d), M.facts(spark, d))


@query("ep", "with a as (select group_id, count(*) as n_all from ep group by 1), s as (select group_id, source, count(*) as n from ep where contains(source, 'self_') group by all) select group_id, source, n, round(n / n_all, 6) as frequency from s join a using (group_id)")
def self_patterns(spark, d):
    return X.self_patterns(M.episodes(spark, d))


@query("fact ent", "with m as (select unnest(episodes) as e, subj, obj from fact), l as (select e, subj as entity from m union all select e, obj from m), c as (select ent.group_id, entity, count(*) as n from l join ent on ent.uuid = l.entity group by all) select group_id, entity, n from c qualify row_number() over (partition by group_id order by n desc, entity) = 1")
def most_mentioned(spark, d):
    return X.most_mentioned(G.mentions(M.facts(spark, d)), M.entities(spark, d))


@query("fact ep ent", """with r as (select uuid, affect, interaction_pattern from (select *, row_number() over (partition by uuid order by created_at, content asc nulls last) as rn from episode where uuid is not null) where rn = 1),
f as (select group_id, 0::bigint as beliefs, 0::bigint as consolidated_edges, count(*) filter (where reinforcement_count > 0) as reinforced_edges from fact group by 1),
e as (select group_id, count(*) filter (where affect is not null and trim(affect) not in ('', '{}')) as affect_tagged_episodes, count(interaction_pattern) as procedural_episodes from ep join r using (uuid) group by 1),
n as (select group_id, count(*) filter (where list_contains(labels, 'trait')) as trait_nodes, count(*) filter (where list_contains(labels, 'goal')) as goal_nodes from ent group by 1)
select group_id, coalesce(beliefs, 0) as beliefs, coalesce(trait_nodes, 0) as trait_nodes, coalesce(goal_nodes, 0) as goal_nodes, coalesce(affect_tagged_episodes, 0) as affect_tagged_episodes, coalesce(consolidated_edges, 0) as consolidated_edges, coalesce(reinforced_edges, 0) as reinforced_edges, coalesce(procedural_episodes, 0) as procedural_episodes
from f full join e using (group_id) full join n using (group_id)""")  # fmt: skip
def cognition_summary(spark, d):
    return X.cognition_summary(M.facts(spark, d), M.episodes(spark, d), M.entities(spark, d))


@query("fact", f"with c as (select group_id, canonical, count(*) as n from fact where {_LIVE} group by all) select group_id, canonical, n, row_number() over (partition by group_id order by n desc, canonical) as place from c qualify place <= 5")
def top_relations(spark, d):
    return X.top_relations(M.facts(spark, d), _now())


@query("ent", """with r as (select uuid, group_id, created_at, interaction_pattern as p from (select *, row_number() over (partition by uuid order by created_at, content asc nulls last) as rn from episode where uuid is not null) where rn = 1 and interaction_pattern is not null),
l as (select *, row_number() over (partition by group_id order by created_at desc, uuid desc) as n from r qualify n <= 8), c as (select group_id, p, count(*) as hits, min(n) as latest from l where p <> '' group by all),
m as (select group_id, p as pattern from c qualify row_number() over (partition by group_id order by hits desc, latest) = 1),
g as (select group_id, string_agg(name, ',' order by uuid) as goals from (select * from ent where list_contains(labels, 'goal') qualify row_number() over (partition by group_id order by uuid) <= 10) group by 1)
select group_id, '' as domains, coalesce(goals, '') as goals, coalesce(pattern, '') as pattern from m full join g using (group_id)""")  # fmt: skip
def prediction_bundle(spark, d):
    return X.prediction_bundle(M.entities(spark, d), M.episodes(spark, d))


@query("fact", "with o as (select * from fact where singleton and status <> 'superseded' and subj is not null and valid_at is not null) select a.uuid, b.uuid as uuid_b from o a join o b on a.group_id = b.group_id and a.subj = b.subj and a.canonical = b.canonical and a.uuid < b.uuid and a.obj <> b.obj where (b.invalid_at is null or a.valid_at < b.invalid_at) and (a.invalid_at is null or b.valid_at < a.invalid_at)")
def contradictions(spark, d):
    return X.contradictions(M.facts(spark, d))


@query("fact ent", "with l as (select distinct unnest(episodes) as episode, uuid as fact, subj, obj from fact), n as (select episode, unnest([subj, obj]) as node from l) select l.episode, count(distinct fact) as n_facts, coalesce(any_value(k.n_nodes), 0) as n_nodes from l left join (select episode, count(distinct node) as n_nodes from n where node in (select uuid from ent) group by 1) k using (episode) group by l.episode")
def nodes_by_episode(spark, d):
    return X.by_episode(M.facts(spark, d), M.entities(spark, d))


@query("ep", "select uuid, coalesce(case when starts_with(trim(content), '{') and json_valid(trim(content)) then json_extract_string(trim(content), '$.body') end, content) as body from ep")
def message_bodies(spark, d):
    return M.episodes(spark, d).select("uuid", X.message_body(F.col("content")).alias("body"))


@query("fact", "select uuid, json_extract_string(qualifiers, '$.season') as season from fact where json_extract_string(qualifiers, '$.season') is not null")
def qualifier_access(spark, d):
    return M.facts(spark, d).select("uuid", F.get_json_object("qualifiers", "$.season").alias("season")).where("season is not null")


@query("ep", "with " + _bm25_sql("ep", "uuid", "content", ["harvest", "review", "cargo"]) + " select uuid, score from bm")
def episode_fulltext(spark, d):
    return S.bm25(M.episodes(spark, d), "uuid", "content", "harvest review cargo")


@query("ent", """with v as (select uuid, name, name_embedding::double[] as v from ent where len(name_embedding) = 64 and len(list_filter(name_embedding, lambda x: isnan(x))) = 0), n as (select *, sqrt(list_dot_product(v, v)) as n from v), q as (select v, n from n where n > 0 order by uuid limit 1),
s as (select n.uuid, round(case when n.n > 0 then list_dot_product(n.v, q.v) / (n.n * q.n) else 0 end, 9) as score from n, q), vec as (select uuid, row_number() over (order by score desc, uuid) as rank from s qualify rank <= 50),
""" + _bm25_sql("ent", "uuid", "name", ["shipping", "partners"]) + """, lex as (select uuid, row_number() over (order by score desc, uuid) as rank from bm qualify rank <= 50)
select uuid, round(sum(1.0 / (60 + rank)), 9) as score from (select * from vec union all select * from lex) group by uuid""")  # fmt: skip
def node_search(spark, d):
    e = M.entities(spark, d)
    sound = e.where(F.size("name_embedding") == 64).where(F.forall("name_embedding", lambda x: ~F.isnan(x)))
    row = sound.where(F.exists("name_embedding", lambda x: x != 0)).orderBy("uuid").select("name_embedding").first()
    vec = S.ranked(S.vector_topk(sound, "uuid", "name_embedding", list(row.name_embedding) if row else [0.0] * 64, 50), F.desc("score"), F.col("uuid"))
    lex = S.ranked(S.bm25(e, "uuid", "name", "shipping partners").orderBy(F.desc("score"), "uuid").limit(50), F.desc("score"), F.col("uuid"))
    return S.fuse([vec, lex], "uuid").select("uuid", F.round("score", 9).alias("score"))


@query("", """select * from (values ('spouse_of', 'wife_of,husband_of,married_to,partner_of', 'symmetric', null, 'state', 'one_current', 'replace', 0.9::double), ('parent_of', 'father_of,mother_of,mom_of,dad_of', 'inverse_pair', 'child_of', 'timeless', 'many_current', 'coexist', 0.9), ('child_of', 'son_of,daughter_of', 'inverse_pair', 'parent_of', 'timeless', 'many_current', 'coexist', 0.9),
  ('sibling_of', 'brother_of,sister_of', 'symmetric', null, 'timeless', 'many_current', 'coexist', 0.9), ('friend_of', 'friends_with', 'symmetric', null, 'state', 'many_current', 'coexist', 0.7), ('lives_in', 'resides_in,based_in,located_in,from', 'directed', null, 'state', 'one_current', 'replace', 0.85), ('works_at', 'employed_by,employee_of,works_for', 'directed', null, 'state', 'one_current', 'replace', 0.85),
  ('member_of', 'belongs_to,part_of', 'directed', null, 'state', 'many_current', 'coexist', 0.7), ('owns', 'has,possesses', 'directed', null, 'state', 'many_current', 'coexist', 0.7), ('owns_pet', 'has_pet,owns_dog,owns_cat,pet_is', 'directed', null, 'state', 'many_current', 'coexist', 0.8), ('is_named', 'is_called,is_aka,name_is,goes_by', 'directed', null, 'state', 'many_current', 'coexist', 0.95),
  ('born_in', 'was_born_in,birthplace_is', 'directed', null, 'timeless', 'one_current', 'replace', 0.95), ('located_in', 'situated_in,found_in', 'directed', null, 'state', 'one_current', 'replace', 0.7), ('contains', 'includes,holds', 'inverse_pair', 'part_of', 'state', 'many_current', 'coexist', 0.7), ('precedes', 'before,happens_before', 'inverse_pair', 'follows', 'event', 'many_historical', 'coexist', 0.7))
  t(canonical, aliases, direction, inverse_name, temporal_kind, cardinality, policy, confidence)""")  # fmt: skip
def default_frames(spark, d):
    return R.default_frames(spark).withColumn("aliases", F.array_join("aliases", ","))
