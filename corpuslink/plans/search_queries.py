"""Queries over vectors, postings and fused ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.shared import workspace
from ..operators import catalog as C
from ..operators import ranking as N
from ..operators import vectors as V
from ..operators.postings import Index

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Live chunks, queries with a vector, and term frequencies, as parts of SQL.
LIVE = """live as (select c.chunk_id as id, c.content as text, c.embedding as vector from m_vchunks c join m_vsources s using (source_id)
  where not c.is_deleted and not s.is_deleted and s.job_status = 'completed')"""
ASKED = "asked as (select q.query_id, q.text, e.embedding as vector from m_queries q join embeddings e on e.vec_id = 10 * q.query_id)"
COSINE = "list_cosine_similarity(q.vector::double[], c.vector::double[])"
DENSE = f"""dense_all as (select q.query_id, c.id, {COSINE} as score from asked q, live c),
dense as (select * from (select *, row_number() over (partition by query_id order by round(score, 12) desc, id) as rank from dense_all) where rank <= 20)"""
TF = """tf as (select id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as term from live)"""
SPARSE = f"""{TF}, sparse_all as (select q.query_id, t.id, 0.1 * count(*) as score from asked q join tf t on t.term = split_part(q.text, ' ', 1) group by 1, 2),
sparse as (select * from (select *, row_number() over (partition by query_id order by round(score, 12) desc, id) as rank from sparse_all) where rank <= 20)"""


def query(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f
    return take


def corpus_of(t):
    c = C.live_chunks(t.m_vchunks, t.m_vsources)
    return c.select(F.col("chunk_id").alias("id"), F.col("content").alias("text"), F.col("embedding").alias("vector"), "source_id", "chunk_index")


def asked(t, words: int | None = None):
    q = t.m_queries.join(t.embeddings.select((F.col("vec_id") / 10).alias("query_id"), F.col("embedding").alias("vector")), "query_id")
    return q if words is None else q.withColumn("text", F.substring_index("text", " ", words))


def posted_of(t, *asked):
    """The postings of the terms that are asked for, of terms and phrases."""
    terms = [a.select("term") for a in asked]
    return N.Asked(corpus_of(t)).posted(reduce(DataFrame.union, terms))


def index_of(corpus):
    """The index of a corpus, built where the session's shared folder is."""
    return Index.build(corpus, workspace(corpus.sparkSession))


def six(df, *names):
    for n in names or ("score",):
        df = df.withColumn(n, F.round(n, 6))
    return df


@query(f"with {ASKED}, {LIVE} select q.query_id, c.id, round({COSINE}, 6) as score from asked q, live c where c.id % 10 = q.query_id")
def v01_cosine(t):
    pairs = asked(t).join(corpus_of(t).withColumnRenamed("vector", "v").drop("text"), F.expr("id % 10 = query_id"))
    return six(pairs.select("query_id", "id", X.cosine(F.col("vector"), F.col("v")).alias("score")))


@query(f"with {ASKED}, {LIVE}, {DENSE} select query_id, id, round(score, 6) as score, rank::int as rank from dense")
def v02_dense_topk(t):
    return six(V.dense_topk(asked(t), corpus_of(t), 20))


@query("""with s as (select a.vec_id as query_id, b.vec_id as id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as score from embeddings a, embeddings b where a.vec_id <> b.vec_id)
select query_id, id, round(score, 6) as score, rank::int as rank from (select *, row_number() over (partition by query_id order by round(score, 12) desc, id) as rank from s) where rank <= 5""")
def v02_dense_self_topk(t):
    e = t.embeddings
    return six(V.dense_topk(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 5, others=True))


@query(f"""with {ASKED}, {LIVE}, s as (select q.query_id, c.id, {COSINE} as score from asked q, live c where (c.id + q.query_id) % 7 = 0)
select query_id, id, round(score, 6) as score, rank::int as rank from (select *, row_number() over (partition by query_id order by round(score, 12) desc, id) as rank from s) where rank <= 5""")
def v03_dense_topk_by_ids(t):
    c = corpus_of(t)
    candidates = c.select("id").withColumn("query_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")))).where("(id + query_id) % 7 = 0")
    return six(V.dense_topk_by_ids(asked(t).select("query_id", "vector"), candidates, c, 5))


@query("""with s as (select a.vec_id as query_id, b.vec_id as id, list_cosine_similarity(list_reverse(a.embedding::double[]), b.embedding::double[]) as score from embeddings a, embeddings b where b.vec_id % 17 <> 0)
select query_id, id, round(score, 6) as score from (select *, row_number() over (partition by query_id order by round(score, 12) desc, id) as k from s) where k = 1""")
def v04_nearest(t):
    e = t.embeddings
    corpus = e.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 17 != 0, F.col("embedding")).alias("vector"))
    return six(V.nearest(e.select(F.col("vec_id").alias("query_id"), F.reverse("embedding").alias("vector")), corpus))


@query()
def v05_embed(t):
    return V.embed(t.documents.select("doc_id", "text"), "text").select("doc_id", "embedding")


@query("select vec_id, vec_id % 17 = 0 as filled, 64 as dims from embeddings")
def v06_backfill_embeddings(t):
    e = t.embeddings.join(t.documents.select(F.col("doc_id").alias("vec_id"), "text"), "vec_id", "left")
    e = e.select("vec_id", F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("vec_id") % 17 != 0, F.col("embedding")).alias("embedding"), F.col("embedding").alias("was"))
    out = V.backfill_embeddings(e, "vec_id", "text")
    return out.select("vec_id", (F.col("embedding") != F.col("was")).alias("filled"), F.size("embedding").alias("dims"))


@query("select doc_id, n_chars::float as a, (doc_id + 0.5)::float as b from documents")
def v07_parse_vector(t):
    v = X.parse_vector(F.concat(F.lit("["), F.col("n_chars").cast("string"), F.lit(", "), F.col("doc_id").cast("string"), F.lit(".5]")))
    return t.documents.select("doc_id", F.get(v, F.lit(0)).alias("a"), F.get(v, F.lit(1)).alias("b"))


@query(f"""with {ASKED}, {LIVE}, {TF}, w as (select query_id, unnest(list_distinct(string_split(text, ' '))) as term from asked), n as (select query_id, count(*) as n from w group by 1)
select w.query_id, t.id from w join (select distinct id, term from tf) t using (term) join n using (query_id) group by w.query_id, t.id, n.n having count(*) = n.n""")
def v08_sparse_match(t):
    terms = N.query_terms(t.m_queries)
    return N.sparse_match(terms, posted_of(t, terms))


@query(f"""with {LIVE}, {TF}, d as (select distinct id, term from tf)
select 0::bigint as query_id, id from d where term in ('that', 'than') and id in (select id from d where term = 'the') and id not in (select id from d where term = 'on') group by id""")
def v08_sparse_match_roles(t):
    terms = t.spark.createDataFrame([(0, "the", "required"), (0, "that", "any"), (0, "than", "any"), (0, "on", "negated")], "query_id long, term string, role string")
    return N.sparse_match(terms, posted_of(t, terms))


@query(f"""with {LIVE} select 0::bigint as query_id, 0 as phrase, id from live where regexp_matches(concat(' ', array_to_string(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), ' '), ' '), ' of the ')
union all select 1, 0, id from live where regexp_matches(concat(' ', array_to_string(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), ' '), ' '), ' that the ')""")
def v08_phrase_match(t):
    rows = [(0, 0, 0, "of"), (0, 0, 1, "the"), (1, 0, 0, "that"), (1, 0, 1, "the")]
    phrases = t.spark.createDataFrame(rows, "query_id long, phrase int, offset int, term string")
    return N.phrase_match(phrases, posted_of(t, phrases))


@query(f"""with {LIVE}, w as (select id, concat(' ', array_to_string(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), ' '), ' ') as t from live)
select 0::bigint as query_id, id from w where contains(t, ' of the ') and contains(t, ' that ') union all select 1, id from w where contains(t, ' the ') and not contains(t, ' of the ')
union all select 2, id from w where contains(t, ' that ') or contains(t, ' of the ')""")
def v08_phrases_with_terms(t):
    terms = t.spark.createDataFrame([(0, "that", "required"), (1, "the", "required"), (2, "that", "any")], "query_id long, term string, role string")
    rows = [(q, 0, k, w, role) for q, role in enumerate(("required", "negated", "any")) for k, w in enumerate(("of", "the"))]
    phrases = t.spark.createDataFrame(rows, "query_id long, phrase int, offset int, term string, role string")
    return N.sparse_match(terms, posted_of(t, terms, phrases), phrases)


@query(f"with {ASKED}, {LIVE}, {SPARSE} select query_id, id, round(score, 6)::double as score, rank::int as rank from sparse")
def v09_sparse_topk(t):
    terms = N.query_terms(asked(t, 1))
    return six(N.sparse_topk(terms, posted_of(t, terms), 20))


@query()
def v09_sparse_topk_terms(t):
    terms = N.query_terms(t.m_queries)
    return six(N.sparse_topk(terms, posted_of(t, terms), 20))


@query(f"""with {ASKED}, {LIVE}, {TF}, p as (select id, term, count(*) as tf from tf group by all), l as (select id, sum(tf) as len from p group by 1), g as (select count(*) as n, avg(len) as a from l),
d as (select term, count(*) as df from p group by 1), w as (select query_id, unnest(list_distinct(string_split(text, ' '))) as term from asked),
s as (select w.query_id, p.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))) as score from w join d using (term) join p using (term) join l using (id), g group by 1, 2)
select query_id, id, round(score, 6) as score, rank::int as rank from (select *, row_number() over (partition by query_id order by round(score, 12) desc, id) as rank from s) where rank <= 20""")
def v10_bm25_topk(t):
    return six(N.bm25_topk(N.query_terms(t.m_queries), N.postings(corpus_of(t)), 20))


#: The first twelve words of each document whose number is divisible by 100 ask all documents.
_ASKING = """w as (select doc_id as id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as term from documents),
q as (select distinct doc_id as query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')[1:12]) as term from documents where doc_id % 100 = 0)"""


@query(f"""with {_ASKING}, p as (select id, term, count(*) as tf from w group by all), l as (select id, sum(tf) as len from p group by 1), g as (select count(*) as n, avg(len) as a from l),
d as (select term, count(*) as df from p group by 1),
s as (select q.query_id, p.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))) as score from q join d using (term) join p using (term) join l using (id), g group by 1, 2)
select query_id, id, round(score, 6) as score, rank::int as rank from (select *, row_number() over (partition by query_id order by round(score, 12) desc, id) as rank from s) where rank <= 10""")
def v10_bm25_all_documents(t):
    docs = t.documents.select(F.col("doc_id").alias("id"), "text")
    words = F.slice(X.simple_terms(F.col("text")), 1, 12)
    terms = docs.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.explode(F.array_distinct(words)).alias("term"))
    return six(N.bm25_topk(terms, index_of(docs), 10))


@query(f"with {LIVE}, {TF} select term, id, count(*) as tf from tf group by all")
def v11_postings_simple(t):
    return N.postings(corpus_of(t)).select("term", "id", "tf")


@query()
def v11_postings_english(t):
    return N.postings(corpus_of(t), "english").select("term", "id", "tf")


@query(f"""with {ASKED}, {LIVE}, {DENSE}, {SPARSE}, u as (select query_id, id, 1.0 / (60 + rank) as s from dense union all select query_id, id, 0.5 / (60 + rank) from sparse)
select query_id, id, round(sum(s), 6)::double as score from u group by 1, 2 having sum(s) >= 0.008""")
def v12_rrf(t):
    return six(N.rrf(_lists(t), 60, 0.008))


@query(f"""with {ASKED}, {LIVE}, {DENSE}, {SPARSE}, u as (select query_id, id, 1.0 / (60 + rank) as s from dense union all select query_id, id, 1.0 / (60 + rank) from sparse)
select query_id, id, round(max(s), 6)::double as score from u group by 1, 2""")
def v13_rrf_max(t):
    return six(N.rrf_max(_lists(t)).drop("list"))


def _lists(t):
    q, c = asked(t, 1), corpus_of(t)
    dense = V.dense_topk(q, c, 20).select("query_id", F.lit("dense").alias("list"), "id", "score", F.lit(1.0).alias("weight"))
    return dense.unionByName(N.sparse_topk(N.query_terms(q), N.postings(c), 20).select("query_id", F.lit("sparse").alias("list"), "id", "score", F.lit(0.5).alias("weight")))


HYBRID = """b as (select coalesce(d.query_id, s.query_id) as query_id, coalesce(d.id, s.id) as id, coalesce(nullif(d.score, 0), nullif(s.score, 0), 0)::double as score
  from dense d full join sparse s on s.query_id = d.query_id and s.id = d.id),
h as (select *, row_number() over (partition by query_id order by round(score, 12) desc, id) as rank from b where score >= 0.2)"""


@query(f"with {ASKED}, {LIVE}, {DENSE}, {SPARSE}, {HYBRID} select query_id, id, round(score, 6) as score, rank::int as rank from h where rank <= 6")
def v14_hybrid_search(t):
    c = corpus_of(t)
    return six(N.hybrid_search(asked(t, 1), c, N.postings(c), 6, 0.2))


#: What each query may see: by one pair of metadata, by two, by one that nothing has; the last query has no filter.
_SEEN = """seen as (select q.query_id, c.chunk_id as id from m_queries q, m_vsources s, m_vchunks c where s.source_id = c.source_id
  and case q.query_id when 0 then s.kind = 'report' when 1 then s.lang = 'de' when 2 then s.kind = 'article' and s.lang = 'de' else q.query_id = 4 end)"""
FILTERED = ", ".join((
    ASKED, LIVE, _SEEN, DENSE.replace("from asked q, live c)", "from asked q, live c, seen where seen.query_id = q.query_id and seen.id = c.id)"),
    SPARSE.replace("group by 1, 2)", "where (q.query_id, t.id) in (select query_id, id from seen) group by 1, 2)"), HYBRID,
))


def filters_of(t):
    pairs = F.expr("explode(case query_id when 0 then map('kind', 'report') when 1 then map('lang', 'de') when 2 then map('kind', 'article', 'lang', 'de') when 3 then map('kind', 'none') end)")
    return t.m_queries.select("query_id", pairs.alias("key", "value"))


def filtered(t):
    """The hybrid search within the sources that have all pairs of a query's filters."""
    filters, c = filters_of(t), corpus_of(t)
    scope = filters.select("query_id").distinct().join(C.metadata_all(t.m_vsources.selectExpr("source_id", "map('kind', kind, 'lang', lang) as metadata"), filters), "query_id", "left")
    return N.hybrid_search(asked(t, 1), c, N.postings(c), 6, 0.2, scope=scope)


INSIGHTS = "live as (select insight_id as id, content as text, embedding as vector from m_insights)"


def insights_of(t):
    return t.m_insights.select(F.col("insight_id").alias("id"), F.col("content").alias("text"), F.col("embedding").alias("vector"))


@query(f"with {ASKED}, {INSIGHTS}, {DENSE}, {SPARSE}, {HYBRID} select query_id, id, round(score, 6) as score, rank::int as rank from h where rank <= 6")
def v15_insight_hybrid_search(t):
    c = insights_of(t)
    return six(N.hybrid_search(asked(t, 1), c, N.postings(c), 6, 0.2))


@query(f"""with {ASKED}, {INSIGHTS}, {DENSE}, {SPARSE}, {HYBRID}, f as (select query_id, id, score, rank from h where rank <= 6),
r as (select l.insight_id, c.source_id, concat('t', cast(c.source_id as varchar)) as topic from m_links l join m_vchunks c on c.chunk_id = l.chunk_id join m_vsources s on s.source_id = c.source_id
  where not c.is_deleted and not s.is_deleted and s.job_status = 'completed'),
d as (select insight_id, array_to_string(list_sort(list_distinct(list(topic))), ',') as topics, array_to_string(list_sort(list_distinct(list(source_id))), ',') as sources from r group by 1)
select query_id, id, round(score, 6) as score, rank::int as rank, topics, sources from f left join d on d.insight_id = f.id""")
def v15_insight_search_details(t):
    found = v15_insight_hybrid_search(t)
    links = t.m_links.join(found.select(F.col("id").alias("insight_id")), "insight_id", "left_semi").join(t.m_vchunks.select("chunk_id", F.array(F.concat(F.lit("t"), "source_id")).alias("topics")), "chunk_id")
    details = C.insight_details(links, t.m_vchunks, t.m_vsources).select(F.col("insight_id").alias("id"), F.array_join("topics", ",").alias("topics"), F.array_join("sources", ",").alias("sources"))
    return found.join(details, "id", "left")


def variants_of(t):
    """Three variants of each query: as it is, a hypothetical text, and one of the expanded kind."""
    names = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("name"), F.lit(w).alias("weight")) for k, n, w in ((0, "original", 1.0), (1, "hyde", 0.65), (2, "expanded", 0.85))]))
    v = t.m_queries.select("query_id", F.substring_index("text", " ", 1).alias("text"), names.alias("n")).select(
        "query_id", "text", "n.name", "n.weight", (F.col("query_id") * 3 + F.col("n.k")).alias("variant_id")
    )
    return v.join(t.embeddings.select(F.col("vec_id").alias("variant_id"), F.col("embedding").alias("vector")), "variant_id")


_VARIANTS = """variants as (select q.query_id, split_part(q.text, ' ', 1) as text, n.name, n.weight, q.query_id * 3 + n.k as variant_id, e.embedding as vector
  from m_queries q, (values (0, 'original', 1.0), (1, 'hyde', 0.65), (2, 'expanded', 0.85)) as n(k, name, weight), embeddings e where e.vec_id = q.query_id * 3 + n.k)"""
BY_VARIANT = _VARIANTS + f""",
asked as (select variant_id as query_id, text, vector from variants), {LIVE}, {DENSE}, {SPARSE}"""


FUSED = """u as (select v.query_id, d.id, v.weight / (60 + d.rank) as s from dense d join variants v on v.variant_id = d.query_id
  union all select v.query_id, d.id, v.weight / (60 + d.rank) from sparse d join variants v on v.variant_id = d.query_id where v.name <> 'hyde'),
f as (select query_id, id, sum(s)::double as score from u group by 1, 2),
fused as (select * from (select *, row_number() over (partition by query_id order by round(score, 12) desc, id) as rank from f) where rank <= 50)"""


@query(f"with {BY_VARIANT}, {FUSED} select query_id, id, round(score, 6) as score, rank::int as rank from fused")
def v16_first_stage(t):
    c = corpus_of(t)
    return six(N.first_stage(variants_of(t), c, N.postings(c)))


@query(f"""with {BY_VARIANT.replace(LIVE, INSIGHTS).replace("rank <= 20", "rank <= 150")}, {HYBRID.replace("0.2", "0.0")},
best as (select v.query_id, h.id, min(h.rank) as r from h join variants v on v.variant_id = h.query_id where h.rank <= 50 group by 1, 2)
select * from (select query_id, id, round(1.0 / (60 + r), 6)::double as score, cast(row_number() over (partition by query_id order by round(1.0 / (60 + r), 12) desc, id) as int) as rank from best) where rank <= 50""")
def v17_insight_first_stage(t):
    c = insights_of(t)
    return six(N.insight_first_stage(variants_of(t), c, N.postings(c)).drop("list"))


@query(f"""with {ASKED}, {LIVE}, {SPARSE}, s as (select q.query_id, c.id, {COSINE} as score from sparse s join asked q using (query_id) join live c on c.id = s.id)
select query_id, id, round(score, 6) as score, rank::int as rank from (select *, row_number() over (partition by query_id order by round(score, 12) desc, id) as rank from s) where rank <= 10""")
def v18_rerank(t):
    q, c = asked(t, 1), corpus_of(t)
    return six(N.rerank(N.sparse_topk(N.query_terms(q), N.postings(c), 20), q, c))
