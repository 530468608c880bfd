"""Queries over expansion, insights, maintenance and jobs."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions.models import map_model
from ..functions.shared import materialize, workspace
from ..operators import catalog as C
from ..operators import expansion as E
from ..operators import graph as G
from ..operators import insights as I
from ..operators import jobs as J
from ..operators import maintenance as M
from ..operators import ranking as N
from ..operators import vectors as V
from ..sources.snapshots import Snapshots
from .search_queries import ASKED, BY_VARIANT, COSINE, DENSE, FILTERED, FUSED, HYBRID, INSIGHTS, LIVE, asked, corpus_of, filtered, insights_of, six, variants_of

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f
    return take


#: Seeds come from all variants of a query; entities are capitalised words; a question on a name has the vector of a row that the query
#: and the length of the name choose, so that SQL can follow it.
_NAMES = """names as (select distinct chunk_id, unnest(regexp_extract_all(content, '\\b[A-Z][a-z]{3,}')) as name from m_vchunks)"""
_SEEDS = f"""{BY_VARIANT}, {FUSED}, {ASKED.replace("asked", "q0", 1)}, {_NAMES},
seeds as (select * from (select *, row_number() over (partition by query_id order by round(score, 12) desc, id) as rank from
  (select q.query_id, c.id, {COSINE} as score from fused f join q0 q using (query_id) join live c on c.id = f.id)) where rank <= 10)"""
_ENT = """ent as (select query_id, seed_id, name, place from (select s.query_id, s.id as seed_id, n.name, row_number() over (partition by s.query_id, s.id order by n.name) as place
  from seeds s join names n on n.chunk_id = s.id) where place <= 5),
a1 as (select e.*, v.embedding as vector from ent e join embeddings v on v.vec_id = 10 * e.query_id + length(e.name))"""
_HOP = f"""h1 as (select q.query_id, q.seed_id, q.name, c.id, {COSINE} as score from a1 q join names n using (name) join live c on c.id = n.chunk_id),
hop as (select * from (select *, row_number() over (partition by query_id, seed_id, name order by round(score, 12) desc, id) as k from h1) where k <= 5 and score >= 0.1 and id <> seed_id)"""
_FALL = f"""place as (select chunk_id as id, source_id, chunk_index from m_vchunks), n1 as (select q.query_id, q.seed_id, q.name, c.id, {COSINE} as score from a1 q join place p on p.id = q.seed_id
  join place p2 on p2.source_id = p.source_id and p2.chunk_index <> p.chunk_index and abs(p2.chunk_index - p.chunk_index) <= 2 join live c on c.id = p2.id
  where not exists (select 1 from hop h where h.query_id = q.query_id and h.seed_id = q.seed_id and h.name = q.name)),
fall as (select * from (select *, row_number() over (partition by query_id, seed_id, name order by round(score, 12) desc, id) as k from n1) where k <= 3 and score >= 0.1)"""
_STEPS = """both_ as (select * from hop union all select * from fall),
few as (select * from (select h.query_id, h.seed_id, h.name, h.id as via_id, n.name as name2, row_number() over (partition by h.query_id, h.seed_id, h.name order by round(h.score, 12) desc, h.id, n.name) as k
  from both_ h join names n on n.chunk_id = h.id where n.name <> h.name) where k <= 5),
few_at as (select f.*, e.place, s.rank from few f join ent e using (query_id, seed_id, name) join seeds s on s.query_id = f.query_id and s.id = f.seed_id),
st as (select query_id, rank as seed_rank, 0 as entity_rank, 0 as hop from seeds union all select e.query_id, s.rank, e.place, 1 from ent e join seeds s on s.query_id = e.query_id and s.id = e.seed_id
  union all select query_id, rank, place, 2 from few_at where k = 1 union all select query_id, rank, place, 2 + k from few_at),
steps as (select * from (select *, row_number() over (partition by query_id order by seed_rank, entity_rank, hop) as spent from st) where spent <= 100),
go as (select t.*, s.id as seed_id, e.name from steps t join seeds s on s.query_id = t.query_id and s.rank = t.seed_rank join ent e on e.query_id = t.query_id and e.seed_id = s.id and e.place = t.entity_rank),
first_ as (select b.* from both_ b join go g on g.query_id = b.query_id and g.seed_id = b.seed_id and g.name = b.name and g.hop = 1),
few2 as (select f.* from few f join go g on g.query_id = f.query_id and g.seed_id = f.seed_id and g.name = f.name and g.hop = 2 + f.k)"""
_SECOND = f"""a2 as (select f.*, v.embedding as vector from few2 f join embeddings v on v.vec_id = 10 * f.query_id + length(f.name2)),
s1 as (select q.query_id, q.seed_id, q.name, q.via_id, q.name2, c.id, {COSINE} as score from a2 q join names n on n.name = q.name2 join live c on c.id = n.chunk_id),
second as (select * from (select *, row_number() over (partition by query_id, seed_id, name, via_id, name2 order by round(score, 12) desc, id) as k2 from s1) where k2 <= 5 and score >= 0.1 and id <> seed_id)"""
_FINAL = f"""again as (select q.query_id, c.id, {COSINE} as score from (select query_id, id from first_ union select query_id, id from second) u join q0 q using (query_id) join live c on c.id = u.id),
f1 as (select x.query_id, x.seed_id as id, max(a.score) as s1 from first_ x join again a using (query_id, id) group by 1, 2), f2 as (select x.query_id, x.seed_id as id, max(a.score) as s2 from second x join again a using (query_id, id) group by 1, 2),
fin as (select * from (select *, row_number() over (partition by query_id order by round(score, 12) desc, id) as rank from
  (select query_id, id, 0.6 * s.score + 0.25 * coalesce(s1, 0) + 0.15 * coalesce(s2, 0) + case when s2 is not null then 0.05 else 0 end as score from seeds s left join f1 using (query_id, id) left join f2 using (query_id, id))) where rank <= 5)"""
_ALL = f"{_SEEDS}, {_ENT}, {_HOP}, {_FALL}, {_STEPS}, {_SECOND}, {_FINAL}"


def _asks(t):
    rows = t.embeddings.select("vec_id", F.col("embedding").alias("vector"))
    return lambda steps, column: steps.withColumn("vec_id", 10 * F.col("query_id") + F.length(column)).join(rows, "vec_id").drop("vec_id")


_DONE: dict = {}


def _once(f):
    """The stages of f, written once for a session, a folder and a number of partitions: several queries show parts of one retrieval."""
    def of(t):
        key = (f.__name__, t.spark.sparkContext.applicationId, t.sf_dir, t.spark.conf.get("spark.sql.shuffle.partitions"))
        if key not in _DONE:
            _DONE[key] = f(t)
        return _DONE[key]

    return of


@_once
def _stages(t):
    c = corpus_of(t)
    return E.retrieve(asked(t), variants_of(t), c, N.Asked(c), G.extract_mentions(t.m_vchunks), asks=_asks(t), least=0.1)


@query(f"with {_SEEDS}, {_ENT} select query_id, seed_id, name, place::int as place from ent")
def k01_seed_entities(t):
    return _stages(t)["entities"].drop("type")


@query(f"with {_SEEDS}, {_ENT}, {_HOP} select query_id, seed_id, name, id, round(score, 6) as score from hop")
def k02_first_hop(t):
    s = _stages(t)
    return six(E.first_hop(_asks(t)(s["entities"], "name"), s["mentions"], s["corpus"], least=0.1).drop("type"))


@query(f"with {_SEEDS}, {_ENT}, {_HOP}, {_FALL} select query_id, seed_id, name, id, round(score, 6) as score from fall")
def k03_neighbor_fallback(t):
    s = _stages(t)
    c, m, q = s["corpus"], s["mentions"], _asks(t)(s["entities"], "name")
    return six(E.neighbor_fallback(q, E.first_hop(q, m, c, least=0.1), c, least=0.1).drop("type"))


@query(f"with {_ALL} select query_id, seed_id, name, via_id, name2, id, round(score, 6) as score from second")
def k04_second_hop(t):
    return six(_stages(t)["second_hop"].drop("type", "type2"))


@query(f"with {_ALL} select query_id, seed_rank::int as seed_rank, entity_rank::int as entity_rank, hop::int as hop, spent from steps")
def k05_expansion_budget(t):
    return _stages(t)["steps"].drop("cost")


@query(f"with {_ALL} select query_id, id, round(score, 6) as score, rank::int as rank from fin")
def k06_finalize_roots(t):
    return six(_stages(t)["final"])


_LINKS = """links as (select a.vec_id as src, b.vec_id as dst, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as similarity from embeddings a, embeddings b
  where a.vec_id <> b.vec_id and list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.3)"""


def _links(t, k):
    """The k nearest of each row that have at least the cosine: of all its links, those that a list of k can show."""
    e = t.embeddings
    pairs = V.dense_topk(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), k, others=True)
    return pairs.where("score >= 0.3").select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.col("score").alias("similarity"))


_FIRST_INSIGHTS = f"""{BY_VARIANT.replace(LIVE, INSIGHTS).replace("rank <= 20", "rank <= 150")}, {HYBRID.replace("0.2", "0.0")},
fused as (select query_id, id, 1.0 / (60 + best) as score from (select *, row_number() over (partition by query_id order by best, id) as k from
  (select v.query_id, h.id, min(h.rank) as best from h join variants v on v.variant_id = h.query_id where h.rank <= 50 group by 1, 2)) where k <= 50),
{ASKED.replace("asked", "q0", 1)}"""
_SEED_INSIGHTS = f"""chosen as (select * from (select *, row_number() over (partition by query_id order by round(s, 12) desc, id) as k from
  (select q.query_id, c.id, f.score, {COSINE} as s from fused f join q0 q using (query_id) join live c on c.id = f.id)) where k <= 5),
final as (select query_id, id, score, row_number() over (partition by query_id order by round(score, 12) desc, id) as rank from chosen)"""
_MUTUAL = """ms as (select a.vec_id as a, b.vec_id as b, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as s from embeddings a, embeddings b where a.label <> b.label),
mk as (select * from (select *, row_number() over (partition by a order by round(s, 12) desc, b) as k from ms) where k <= 10),
links as (select x.a as src, x.b as dst, x.s as similarity from mk x join mk y on y.a = x.b and y.b = x.a)"""
_RELATED = f"""near as (select * from (select f.query_id, f.id as seed_id, l.dst as id, l.similarity as score, row_number() over (partition by f.query_id, f.id order by round(l.similarity, 12) desc, l.dst) as rank
  from final f join links l on l.src = f.id) where rank <= 10),
ask2 as (select n.query_id, n.seed_id, n.rank as group_no, 'that' as text, e.embedding as vector from near n join embeddings e on e.vec_id = n.rank + 10 * n.query_id where n.rank <= 3),
d2 as (select *, row_number() over (partition by query_id, seed_id, group_no order by round(score, 12) desc, id) as rank from (select q.query_id, q.seed_id, q.group_no, c.id, {COSINE} as score from ask2 q, live c)),
p2 as (select *, row_number() over (partition by query_id, seed_id, group_no order by round(score, 12) desc, id) as rank from
  (select q.query_id, q.seed_id, q.group_no, t.id, 0.1 * count(*) as score from ask2 q join tf t on t.term = q.text group by all)),
b2 as (select coalesce(d.query_id, s.query_id) as query_id, coalesce(d.seed_id, s.seed_id) as seed_id, coalesce(d.group_no, s.group_no) as group_no, coalesce(d.id, s.id) as id, coalesce(nullif(d.score, 0), nullif(s.score, 0), 0)::double as score
  from (select * from d2 where rank <= 20) d full join (select * from p2 where rank <= 20) s on s.query_id = d.query_id and s.seed_id = d.seed_id and s.group_no = d.group_no and s.id = d.id),
g2 as (select *, row_number() over (partition by query_id, seed_id, group_no order by round(score, 12) desc, id) as rank from b2 where score >= 0),
rows_ as (select query_id, seed_id, 0 as group_no, rank, id, score from near union all select query_id, seed_id, group_no, rank, id, score from g2 where rank <= 5),
related as (select * from (select *, row_number() over (partition by query_id, seed_id, id order by group_no, rank) as k from rows_ where id <> seed_id) where k = 1)"""


@_once
def _insight_stages(t):
    rows = t.embeddings.select("vec_id", F.col("embedding").alias("vector"))
    ask = lambda steps, column: steps.withColumn("vec_id", F.col("group_no") + 10 * F.col("query_id")).join(rows, "vec_id").withColumn("text", F.lit("that"))
    rows_of_links = t.embeddings.selectExpr("vec_id as id", "embedding as vector", "array(label) as sources")
    links = lambda of: I.mutual_links(rows_of_links, of=of)
    c, topics = materialize(insights_of(t)), t.m_vchunks.select("chunk_id", F.array(F.concat(F.lit("t"), "source_id")).alias("topics"))
    return E.retrieve_insights(asked(t), variants_of(t), c, N.Asked(c), links, asks=ask, details=C.insight_details(t.m_links.join(topics, "chunk_id"), t.m_vchunks, t.m_vsources))


@query(f"with {_FIRST_INSIGHTS}, {_SEED_INSIGHTS}, {_MUTUAL}, {_RELATED} select query_id, seed_id, group_no::int as group_no, rank::int as rank, id, round(score, 6) as score from related")
def k07_expand_insights(t):
    return six(_insight_stages(t)["related"].drop("sub_query", "topics", "sources"))


@query(f"""with {_FIRST_INSIGHTS}, {_SEED_INSIGHTS}, {_MUTUAL}, {_RELATED},
r as (select l.insight_id, c.source_id, concat('t', cast(c.source_id as varchar)) as topic from m_links l join m_vchunks c on c.chunk_id = l.chunk_id join m_vsources s on s.source_id = c.source_id
  where not c.is_deleted and not s.is_deleted and s.job_status = 'completed'),
d as (select insight_id, array_to_string(list_sort(list_distinct(list(topic))), ',') as topics, array_to_string(list_sort(list_distinct(list(source_id))), ',') as sources from r group by 1)
select query_id, seed_id, group_no::int as group_no, rank::int as rank, id, case when group_no > 0 then 'that' end as sub_query, topics, sources from related left join d on d.insight_id = related.id""")
def k07_related_details(t):
    rows = _insight_stages(t)["related"]
    return rows.select("query_id", "seed_id", "group_no", "rank", "id", "sub_query", F.array_join("topics", ",").alias("topics"), F.array_join("sources", ",").alias("sources"))


@query(f"with {_FIRST_INSIGHTS}, {_SEED_INSIGHTS} select query_id, id, round(score, 6)::double as score, rank::int as rank from final")
def k11_retrieve_insights(t):
    return six(_insight_stages(t)["final"].drop("list"))


@query(f"with {ASKED}, live as (select insight_id as id, content as text, embedding as vector from m_insights), {DENSE} select query_id, id, round(score, 6) as score, rank::int as rank from dense where rank <= 5")
def k08_finalize_insights(t):
    c = t.m_insights.select(F.col("insight_id").alias("id"), F.col("embedding").alias("vector"))
    return six(N.ranked(V.dense_topk(asked(t), c, 20).drop("rank"), 5))


_TOK = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'))"
_CONTEXT = f"""with recursive c as (select chunk_id as id, source_id, chunk_index, content as text from m_vchunks),
n as (select a.id, case when b.chunk_index > a.chunk_index then b.chunk_index - a.chunk_index else 2 + a.chunk_index - b.chunk_index end as step, b.text as near, b.chunk_index > a.chunk_index as after
  from c a join c b on b.source_id = a.source_id and b.chunk_index <> a.chunk_index and abs(b.chunk_index - a.chunk_index) <= 2),
r as (select id, 0 as step, text as t, false as s1, false as s2 from c
  union all select r.id, r.step + 1,
    case when n.near is null or {_TOK.format('r.t')} >= 200 or (n.after and r.s1) or (not n.after and r.s2) or {_TOK.format('case when n.after then concat(r.t, chr(10), chr(10), n.near) else concat(n.near, chr(10), chr(10), r.t) end')} > 600
      then r.t when n.after then concat(r.t, chr(10), chr(10), n.near) else concat(n.near, chr(10), chr(10), r.t) end,
    r.s1 or coalesce(n.after and {_TOK.format('concat(r.t, chr(10), chr(10), n.near)')} > 600, false), r.s2 or coalesce(not n.after and {_TOK.format('concat(n.near, chr(10), chr(10), r.t)')} > 600, false)
  from r left join n on n.id = r.id and n.step = r.step + 1 where r.step < 4)
select id, t as context from r where step = 4"""


@query(_CONTEXT)
def k09_expand_context(t):
    c = t.m_vchunks.selectExpr("chunk_id as id", "source_id", "chunk_index", "content as text")
    return E.expand_context(c, c)


_SHOWN = """shown as (select query_id, id as seed_id, 'root' as level, id from fin union select f.query_id, f.seed_id, 'first', f.id from first_ f join fin on fin.query_id = f.query_id and fin.id = f.seed_id
  union select s.query_id, s.seed_id, 'second', s.id from second s join fin on fin.query_id = s.query_id and fin.id = s.seed_id)"""
_LIVE_CONTEXT = _CONTEXT.replace("from m_vchunks)", "from m_vchunks where chunk_id in (select id from live))", 1).removeprefix("with recursive ").replace("select id, t as context from r where step = 4", "").rstrip()


@query(f"with recursive {FILTERED}, {_LIVE_CONTEXT} select query_id, h.id, round(score, 6) as score, rank::int as rank, cast(length(r.t) as int) as n_chars from h join r on r.id = h.id and r.step = 4 where rank <= 6")
def v14_hybrid_search_filtered(t):
    return six(E.apply_context(filtered(t), corpus_of(t))).select("query_id", "id", "score", "rank", F.length("context").alias("n_chars"))


@query(f"with recursive {_ALL}, {_SHOWN}, {_LIVE_CONTEXT} select query_id, seed_id, level, s.id, cast(length(r.t) as int) as n_chars from shown s join r on r.id = s.id and r.step = 4")
def k10_apply_context(t):
    return _stages(t)["contexts"].select("query_id", "seed_id", "level", "id", F.length("context").alias("n_chars"))


@query(f"""with {_ALL}, h as (select query_id, seed_id as id, count(distinct id) as n_first from first_ group by 1, 2), s as (select query_id, seed_id as id, count(distinct id) as n_second from second group by 1, 2)
select query_id, id, round(score, 6) as score, rank::int as rank, coalesce(n_first, 0) as n_first, coalesce(n_second, 0) as n_second from fin left join h using (query_id, id) left join s using (query_id, id)""")
def k11_retrieve(t):
    s = _stages(t)
    n = lambda stage, name: s[stage].groupBy("query_id", F.col("seed_id").alias("id")).agg(F.countDistinct(s[stage]["id"]).alias(name))
    rows = s["final"].join(n("first_hop", "n_first"), ["query_id", "id"], "left").join(n("second_hop", "n_second"), ["query_id", "id"], "left")
    return six(rows.fillna(0, ["n_first", "n_second"]))


@query(rf"""with {_ALL}, every as (select query_id, 'fused' as stage, id, score from fused union all select query_id, 'roots', id, score from seeds union all select query_id, 'first_hop', id, max(score) from first_ group by all
  union all select query_id, 'second_hop', id, max(score) from second group by all union all select query_id, 'final', id, score from fin),
top as (select *, row_number() over (partition by query_id, stage order by round(score, 12) desc, id) as place from every),
flat as (select id, trim(regexp_replace(text, '\s+', ' ', 'g')) as x from live)
select query_id, stage, id, place::int as place, case when length(x) > 180 then concat(rtrim(substr(x, 1, 179)), '…') else x end as preview from top join flat using (id) where place <= 5""")
def k12_retrieve_trace(t):
    return E.retrieve_trace(_stages(t), _stages(t)["corpus"])


def _said(prompts):
    import json

    return [json.dumps({"insights": [{"insight": p[:40], "topics": [p.split()[0]]}, {"insight": p[40:80], "topics": "x"}]}) for p in prompts]


@query()
def i01_extract_insights(t):
    return I.extract_insights(t.m_vchunks, _said).select("source_id", "chunk_id", "seq", "insight")


@query("""with s as (select a.vec_id as seq, b.vec_id as id, list_cosine_similarity(list_reverse(a.embedding::double[]), b.embedding::double[]) as score from embeddings a, embeddings b),
r as (select *, row_number() over (partition by seq order by round(score, 12) desc, id) as k from s) select seq, id as existing_id, round(score, 6) as score from r where k = 1 and score >= 0.3""")
def i02_match_existing(t):
    e = t.embeddings
    return six(I.match_existing(e.selectExpr("vec_id as seq", "reverse(embedding) as vector"), e.selectExpr("vec_id as id", "embedding as vector"), 0.3))


_GREEDY = """with recursive p as (select b.vec_id as seq, a.vec_id as earlier, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as s from embeddings a join embeddings b on a.vec_id < b.vec_id
  where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.3),
adj as (select vec_id as seq, coalesce(list(earlier) filter (where earlier is not null), []) as es from embeddings left join p on p.seq = vec_id group by 1),
o as (select *, row_number() over (order by seq) as n from adj),
r as (select 0::bigint as n, []::bigint[] as kept union all select o.n, case when {kept} then list_append(r.kept, o.seq) else r.kept end from r join o on o.n = r.n + 1),
l as (select unnest(kept) as seq from (select kept from r order by n desc limit 1)),
to_ as (select p.seq, max_by(p.earlier, [round(s, 12), -p.earlier]) as to from p join l on l.seq = p.earlier group by 1)
select v.vec_id as seq, case when l.seq is not null then v.vec_id else to_.to end as insight_seq, l.seq is not null as is_new from embeddings v left join l on l.seq = v.vec_id left join to_ on to_.seq = v.vec_id {where}"""


@query(_GREEDY.format(kept="not list_has_any(r.kept, o.es)", where=""))
def i03_dedup_within_batch(t):
    return I.dedup_in_order(t.embeddings.selectExpr("vec_id as seq", "embedding as vector"), 0.3)


@query(_GREEDY.format(kept="o.seq < 100 or not list_has_any(r.kept, o.es)", where="where v.vec_id >= 100"))
def i04_upsert_insights(t):
    e = t.embeddings.selectExpr("vec_id as seq", "embedding as vector")
    return I.dedup_in_order(e.where("seq >= 100"), 0.3, e.where("seq < 100"))


@query("select l_orderkey as chunk_id, l_partkey as insight_id, max_by(l_returnflag, l_linenumber * 1000000 + l_suppkey) as topics from lineitem group by 1, 2")
def i05_link_chunk_insights(t):
    return I.link_chunk_insights(t.lineitem.selectExpr("l_orderkey as chunk_id", "l_partkey as insight_id", "l_returnflag as topics", "l_linenumber * 1000000 + l_suppkey as seq"))


@query("select distinct l_orderkey as chunk_id, l_partkey as insight_id, l_returnflag as topics from lineitem")
def i05b_contains_edges(t):
    return I.contains_edges(t.lineitem.selectExpr("l_orderkey as chunk_id", "l_partkey as insight_id", "l_returnflag as topics"))


_MUTUAL_ROWS = """with s as (select a.vec_id as a, b.vec_id as b, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as s from embeddings a, embeddings b where a.label <> b.label),
k as (select * from (select *, row_number() over (partition by a order by round(s, 12) desc, b) as k from s) where k <= 10)
select x.a as src, x.b as dst, round(x.s, 6) as similarity from k x join k y on y.a = x.b and y.b = x.a"""


@query(_MUTUAL_ROWS)
def i06_mutual_links(t):
    return six(I.mutual_links(t.embeddings.selectExpr("vec_id as id", "embedding as vector", "array(label) as sources")), "similarity")


@query(_MUTUAL_ROWS)
def i06_mutual_links_in_batches(t):
    """The same links when the insights come in three batches, none of which compares the stored ones again."""
    rows = t.embeddings.selectExpr("vec_id as id", "embedding as vector", "array(label) as sources")
    batch = lambda n: rows.where(F.col("id") % 3 == n)
    near, stored = materialize(I.nearest_apart(batch(0), batch(0))), batch(0)
    for n in (1, 2):
        near, stored = materialize(I.extend_nearest(near, stored, batch(n))), stored.unionByName(batch(n))
    return six(I.mutual(near), "similarity")


@query(f"with {_LINKS}, r as (select *, row_number() over (partition by src order by round(similarity, 12) desc, dst) as k from links) select src, dst, round(similarity, 6) as similarity, k::int as rank from r where k <= 3")
def i07_related(t):
    return six(I.related(_links(t, 3), t.embeddings.selectExpr("vec_id as id"), 3), "similarity")


@query("select source_id, count(*) as n_chunks, count(*) filter (where chunk_id % 3 = 0) as n_new, count(*) filter (where chunk_id % 3 <> 0) as n_reused from m_vchunks group by 1")
def d10_extraction_stats(t):
    return I.extraction_stats(t.m_vchunks.selectExpr("source_id", "chunk_id", "chunk_id % 3 = 0 as is_new"))


def _tables(t):
    return {"sources": t.m_vsources, "jobs": t.m_jobs.where("source_id < 10"), "chunks": t.m_vchunks, "mentions": G.extract_mentions(t.m_vchunks), "links": t.m_links, "insights": t.m_insights}


def _counts(tables):
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""with gone as (select chunk_id from m_vchunks where source_id in (2, 5)), kept as (select * from m_links where chunk_id not in (select chunk_id from gone))
select 'chunks' as table_name, (select count(*) from m_vchunks where source_id not in (2, 5)) as n union all select 'jobs', (select count(*) from m_jobs where source_id < 10 and source_id not in (2, 5))
union all select 'links', (select count(*) from kept) union all select 'sources', 8
union all select 'mentions', (select count(*) from (select unnest(regexp_extract_all(content, '\\b[A-Z][a-z]{3,}')) from m_vchunks where source_id not in (2, 5)))
union all select 'insights', (select count(*) from m_insights where insight_id in (select insight_id from kept) or insight_id not in (select insight_id from m_links))""")
def m01_delete_sources(t):
    return _counts(M.delete_sources(_tables(t), t.m_vsources.where("source_id in (2, 5)").select("source_id")))


def _labelled(t):
    """Links of the documents that have labels, each to an insight of its own number."""
    return t.labels.selectExpr("doc_id as chunk_id", "doc_id as insight_id")


@query("select insight_id from m_insights where insight_id in (select doc_id from labels)")
def m02_drop_orphan_insights(t):
    return M.drop_orphan_insights(t.m_insights, _labelled(t)).select("insight_id")


@query("select source_id, is_deleted or kind = 'youtube' as is_deleted from m_sources")
def m03_soft_delete(t):
    return M.soft_delete(t.m_sources, t.m_sources.where("kind = 'youtube'")).select("source_id", "is_deleted")


@query("""with j as (select source_id, case source_id when 1 then 3 when 2 then 5 when 3 then 6 when 4 then 8 end as lvl from m_vsources where source_id between 1 and 4), c as (select m.*, j.lvl from m_vchunks m left join j using (source_id))
select 'chunks' as table_name, (select count(*) from c where lvl is null or lvl > 3) as n union all select 'links', (select count(*) from m_links where chunk_id not in (select chunk_id from c where lvl is not null))
union all select 'mentions', (select count(*) from (select unnest(regexp_extract_all(content, '\\b[A-Z][a-z]{3,}')) from c where lvl is null or lvl > 6))
union all select 'vectors', (select count(*) from c where (lvl is null or lvl > 3) and (lvl is null or lvl > 5))""")
def m04_cleanup_from_stage(t):
    stage = F.expr("element_at(array('chunking', 'embedding', 'graph_extraction', 'insight_extraction'), cast(source_id as int))")
    jobs = t.m_vsources.where("source_id between 1 and 4").select("source_id", stage.alias("stage"))
    kept = M.cleanup_from_stage(_tables(t), jobs)
    return _counts(kept | {"vectors": kept["chunks"].where("embedding is not null")})


@query("""select source_id from m_sources s where not is_deleted and source_id in (select vec_id from embeddings) and source_id not in (select doc_id from labels where doc_id is not null) order by created_at desc, source_id limit 40""")
def m05_pending_insight_sources(t):
    chunks = t.embeddings.selectExpr("vec_id as chunk_id", "vec_id as source_id", "false as is_deleted")
    return M.pending_insight_sources(t.m_sources, chunks, _labelled(t), 40).select("source_id")


@query("select source_id from m_sources where not is_deleted and (source_id not in (select doc_id from labels where doc_id is not null) or source_id not in (select vec_id from embeddings))")
def m06_rebuild_insights(t):
    chunks = t.embeddings.selectExpr("vec_id as chunk_id", "vec_id as source_id", "false as is_deleted")
    return M.sources_to_rebuild(t.m_sources, chunks, _labelled(t)).select("source_id")


def first_sentences(texts):
    """Stands for a model: the first two lines of six words of a text are its insights."""
    out = []
    for text in texts:
        words = (text or "").split()
        said = [" ".join(words[k : k + 6]) for k in (0, 6) if words[k : k + 6]]
        out.append(json.dumps({"insights": [{"insight": x, "topics": [x.split()[0]]} for x in said]}))
    return out


@query()
def m06_rebuild_by_force(t):
    """All reports are built anew; both tables are committed as one version and read back."""
    tables = {"chunks": t.m_vchunks, "links": t.m_links.withColumn("topics", F.array(F.lit("old"))), "insights": t.m_insights}
    asked = t.m_vsources.where("kind = 'report' and not is_deleted")
    built, _ = M.rebuild_insights(tables, asked, first_sentences, force=True)
    store = Snapshots(t.spark, workspace(t.spark))
    store.commit(built)
    now = store.read()
    return now["links"].join(now["insights"].select("insight_id", "content"), "insight_id").select("chunk_id", "insight_id", F.array_join("topics", ",").alias("topics"), "content")


@query("select chunk_id, insight_id from m_links where chunk_id = insight_id")
def m07_drop_edge_types(t):
    edges = t.m_links.withColumn("type", F.when(F.col("chunk_id") == F.col("insight_id"), "CONTAINS").otherwise("RELATED_TO"))
    return M.drop_edge_types(edges).select("chunk_id", "insight_id")


@query("""select job_id, case when status = 'completed' and source_id % 2 = 0 then 'pending' else status end as status, case when status = 'completed' and source_id % 2 = 0 then null else current_stage end as current_stage,
case when status = 'completed' and source_id % 2 = 0 then 'profiling' end as retry_from from m_jobs""")
def m08_requeue(t):
    affected = t.m_jobs.where("source_id % 2 = 0").select("source_id")
    return M.requeue(t.m_jobs, affected, "profiling").select("job_id", "status", "current_stage", "retry_from")


@query("select source_id from m_sources where not is_deleted and kind = 'youtube' and source_id % 4 = 2")
def m09_purge_dry_run(t):
    return M.purge({"sources": t.m_sources}, "youtube")[0].select("source_id")


@query("""with gone as (select source_id from m_vsources where kind = 'report' and not is_deleted), lost as (select chunk_id from m_vchunks where source_id in (select source_id from gone)),
kept as (select * from m_links where chunk_id not in (select chunk_id from lost))
select 'chunks' as table_name, (select count(*) from m_vchunks where chunk_id not in (select chunk_id from lost)) as n union all select 'jobs', (select count(*) from m_jobs where source_id not in (select source_id from gone))
union all select 'links', (select count(*) from kept) union all select 'sources', (select count(*) from m_vsources where source_id not in (select source_id from gone))
union all select 'mentions', (select count(*) from (select unnest(regexp_extract_all(content, '\\b[A-Z][a-z]{3,}')) from m_vchunks where chunk_id not in (select chunk_id from lost)))
union all select 'insights', (select count(*) from m_insights where insight_id in (select insight_id from kept) or insight_id not in (select insight_id from m_links))""")
def m09_purge(t):
    sources = t.m_vsources.withColumn("created_at", F.col("source_id"))
    return _counts(M.purge(_tables(t) | {"sources": sources, "jobs": t.m_jobs}, "report", execute=True)[1])


@query("""with l as (select job_id, stage, max_by(state, [epoch_us(updated_at), event_id]) as state, max([epoch_us(updated_at), event_id]) as lst from m_job_events group by 1, 2),
j as (select job_id, max_by(stage, lst) as s, max_by(state, lst) as st, count(*) as n from l group by 1)
select job_id, case when st in ('failed', 'processing') then concat(st, ':', s) else st end as status, n as n_stages from j""")
def s01_fold_stage_log(t):
    return J.fold_stage_log(t.m_job_events).select("job_id", "status", F.size("stage_log").cast("long").alias("n_stages"))


@query("""select job_id, concat('failed:', split_part(status, ':', 2)) as status, concat('no progress in ', split_part(status, ':', 2)) as error from m_jobs
where status like 'processing:%' and updated_at < timestamp '2024-01-05 00:00:00' - interval 30 minutes""")
def s02_stuck_jobs(t):
    return J.stuck_jobs(t.m_jobs, "2024-01-05 00:00:00")


@query("""select job_id, row_number() over (order by updated_at, job_id) as place, case when job_id % 5 = 0 then 'embedding' else 'parsing' end as start_stage from m_jobs where status = 'pending'""")
def s03_claim_order(t):
    return J.claim_order(t.m_jobs.withColumn("retry_from", F.expr("if(job_id % 5 = 0, 'embedding', null)")))


@query("""select job_id, case when status like 'failed%' then 'pending' else status end as status, case when status like 'failed%' then 'chunking' end as retry_from,
case when status not like 'failed%' then concat('status is ', status) end as rejected from m_jobs""")
def s04_retry(t):
    return J.retry(t.m_jobs, "chunking")


@query("""select job_id, case when status = 'pending' or status like 'processing:%' then 'cancelled' else status end as status,
case when not (status = 'pending' or status like 'processing:%') then concat('status is ', status) end as rejected from m_jobs""")
def s04_cancel(t):
    return J.cancel(t.m_jobs)


@query("""select job_id, stage, cast(floor((epoch_us(max(updated_at)) - epoch_us(min(updated_at))) / 1000) as bigint) as duration_ms from m_job_events group by 1, 2 having bool_or(state = 'completed')""")
def s05_stage_durations(t):
    return J.stage_durations(t.m_job_events)


@query("select date_trunc('day', updated_at)::timestamp as start, state, count(*) as n from m_job_events group by 1, 2")
def s07_event_windows(t):
    return J.event_windows(t.m_job_events)


@query("select doc_id, upper(source) as answer from documents")
def u01_map_model(t):
    return map_model(t.documents.select("doc_id", "source"), "source", lambda ps: [p.upper() for p in ps]).select("doc_id", "answer")
