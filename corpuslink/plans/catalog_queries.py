"""Queries over documents and the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.shared import workspace
from ..operators import catalog as C
from ..operators import documents as D
from ..streaming.ingest import ANY_AGE, ingest

IMAGES = "concat(text, '\n![a](img/', cast(doc_id as varchar(20)), '.png) ![b](https://x/y.png) ![c](z.exe)')"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f
    return take


@query("""with d as (select doc_id, md5(text) as md5, doc_id as arrived_at from documents),
live as (select md5, min(source_id) as live_id from m_sources where not is_deleted group by md5),
r as (select d.*, live_id, row_number() over w as k, first_value(doc_id) over w as winner from d left join live using (md5)
  window w as (partition by md5 order by arrived_at, doc_id))
select doc_id, md5, coalesce(live_id, case when k > 1 then winner end) is null as accepted, coalesce(live_id, case when k > 1 then winner end) as existing_id from r""")
def a03_submit(t):
    docs = t.documents.select("doc_id", F.col("text").alias("content"), F.col("doc_id").alias("arrived_at"))
    return D.submit(docs, t.m_sources)


@query("""with r as (select doc_id, md5(text) as md5, first(doc_id) over (partition by md5(text) order by doc_id) as winner from documents where text is not null)
select doc_id, md5, doc_id = winner as accepted, case when doc_id <> winner then winner end as existing_id from r""")
def s06_submit_stream(t):
    """The documents as a stream that is submitted batch by batch, and what became of each."""
    schema = t.documents.schema
    files = t.spark.readStream.schema(schema).option("maxFileAge", ANY_AGE)
    # A stream reads folders; where the table is one file it is that file of its folder.
    if t.documents.inputFiles()[0].endswith("/documents.parquet"):
        stream = files.option("pathGlobFilter", "documents.parquet").parquet(t.sf_dir)
    else:
        stream = files.parquet(f"{t.sf_dir}/documents.parquet")
    stream = stream.where("text is not null")
    number = F.lpad(F.col("doc_id").cast("string"), 20, "0")
    docs = stream.select(number.alias("source_id"), F.col("doc_id").cast("string").alias("name"), F.md5("text").alias("md5"), "text", F.col("doc_id").alias("arrived_at"))
    out = workspace(t.spark)
    ingest(docs, out, f"{out}/progress", embedder=None).awaitTermination()
    told = t.spark.read.parquet(f"{out}/submitted")
    return told.select(F.col("source_id").cast("long").alias("doc_id"), "md5", "accepted", F.col("existing_id").cast("long").alias("existing_id"))


@query("""select doc_id, lang as v_lang, origin as v_origin, 'submitted' as v_kind, 3 as n_keys
from (select doc_id, lang, source as origin from documents)""")
def a04_merge_metadata(t):
    extracted = F.create_map(F.lit("lang"), F.col("lang"), F.lit("kind"), F.lit("extracted"))
    submitted = F.create_map(F.lit("origin"), F.col("source"), F.lit("kind"), F.lit("submitted"))
    m = t.documents.select("doc_id", D.merge_metadata(extracted, submitted).alias("m"))
    get = lambda k: F.try_element_at("m", F.lit(k)).alias(f"v_{k}")
    return m.select("doc_id", get("lang"), get("origin"), get("kind"), F.size("m").alias("n_keys"))


@query(f"""with d as (select doc_id, {IMAGES} as text from documents),
r as (select doc_id, regexp_extract_all(text, '!\\[[^\\]]*\\]\\(([^)]+)\\)', 1) as a from d),
u as (select doc_id, unnest(range(len(a))) as pos, unnest(a) as target from r)
select doc_id, cast(pos as int) as pos, target, case when regexp_matches(target, '^(https?://|data:)') then 'remote'
  when lower(regexp_extract(target, '\\.([A-Za-z0-9]+)$', 1)) in ('png','jpg','jpeg','gif','webp','bmp','tiff','svg') then 'local' else 'unsupported' end as kind from u""")
def a05_image_refs(t):
    return D.image_refs(t.documents.selectExpr("doc_id", f"{IMAGES} as text"))


@query("""select doc_id, case when doc_id % 2 = 0 then concat(text, '\n[picture ', cast(doc_id as varchar), '] ![b](https://x/y.png) ![c](z.exe)')
  else concat(text, '\n![a](img/', cast(doc_id as varchar), '.png) ![b](https://x/y.png) ![c](z.exe)') end as text from documents""")
def a06_inline_image_text(t):
    docs = t.documents.selectExpr("doc_id", f"{IMAGES} as text")
    said = docs.where("doc_id % 2 = 0").selectExpr("doc_id", "0 as pos", "concat('[picture ', doc_id, ']') as description")
    return D.inline_image_text(docs, said)


@query("""select doc_id, concat('a ', case when doc_id % 3 = 0 then '<!-- image --> b <!-- image --> c <!-- image -->' when doc_id % 3 = 1 then concat(lang, ' b <!-- image --> c <!-- image -->')
  else concat(lang, ' b ', source, ' c <!-- image -->') end) as text from documents""")
def a07_fill_image_placeholders(t):
    said = F.expr("case doc_id % 3 when 0 then array(cast(null as string)) when 1 then array(null, lang) else array(lang, null, source) end")
    return t.documents.select("doc_id", D.fill_image_placeholders(F.lit("a <!-- image --> b <!-- image --> c <!-- image -->"), said).alias("text"))


@query("""with l as (select doc_id, lang, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as a from documents)
select doc_id, concat('_root_', case when doc_id % 2 = 0 then concat(chr(10), 'Title ', lang) else '' end, chr(10),
  array_to_string(list_transform(case when doc_id % 2 = 0 then list_concat([concat('# Title ', lang)], a) else a end,
    lambda x, i: concat(cast(i + 1 as varchar), ': ', trim(x))), chr(10))) as outline from l""")
def a08_line_outline(t):
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# Title "), "lang", F.lit("\n"), "text")).otherwise(F.col("text"))
    return t.documents.select("doc_id", D.line_outline(text).alias("outline"))


@query("select 'delete' as action, 'source' as resource_type, cast(source_id as varchar) as resource_id, kind as m_kind from m_sources where is_deleted")
def a11_audit(t):
    rows = D.audit_rows(t.m_sources.where("is_deleted"), "delete", "source", "source_id", {"kind": "kind"})
    return rows.select("action", "resource_type", "resource_id", F.element_at("metadata", F.lit("kind")).alias("m_kind"))


@query("""select c.chunk_id, c.source_id, c.chunk_index, p.chunk_id as parent_chunk_id from m_vchunks c
left join m_vchunks p on p.source_id = c.source_id and c.chunk_index % 4 <> 0 and p.chunk_index = c.chunk_index - c.chunk_index % 4""")
def a12_chunk_parents(t):
    chunks = t.m_vchunks.selectExpr("chunk_id", "source_id", "chunk_index", "if(chunk_index % 4 = 0, null, chunk_index - chunk_index % 4) as parent_index")
    return D.with_parents(chunks).select("chunk_id", "source_id", "chunk_index", "parent_chunk_id")


@query("""select c.chunk_id, c.source_id from m_vchunks c join m_vsources s using (source_id)
where not c.is_deleted and not s.is_deleted and s.job_status = 'completed' and c.embedding is not null""")
def b01_live_chunks(t):
    return C.live_chunks(t.m_vchunks, t.m_vsources).select("chunk_id", "source_id")


@query("""select s.query_id, c.chunk_id from m_vchunks c join (select query_id, query_id * 2 as source_id from m_queries where query_id < 3) s using (source_id)
union all select q.query_id, c.chunk_id from m_vchunks c, (select query_id from m_queries where query_id >= 3) q""")
def b02_in_sources(t):
    scope = t.m_queries.selectExpr("query_id", "if(query_id < 3, query_id * 2, null) as source_id")
    return C.in_sources(t.m_vchunks, scope).select("query_id", "chunk_id")


def _with_metadata(t):
    return t.m_sources.select("source_id", F.create_map(F.lit("kind"), "kind", F.lit("lang"), "lang", F.lit("origin"), "origin").alias("metadata"))


def _filters(t):
    return t.spark.createDataFrame([(0, "kind", "report"), (0, "lang", "en"), (1, "lang", "de"), (2, "origin", "src1"), (2, "kind", "paper")], "query_id long, key string, value string")


@query("""select 0::bigint as query_id, source_id from m_sources where kind = 'report' and lang = 'en'
union all select 1, source_id from m_sources where lang = 'de' union all select 2, source_id from m_sources where origin = 'src1' and kind = 'paper'""")
def b03_metadata_all(t):
    return C.metadata_all(_with_metadata(t), _filters(t))


@query("""select 0::bigint as query_id, source_id from m_sources where kind = 'report' or lang = 'en'
union all select 1, source_id from m_sources where lang = 'de' union all select 2, source_id from m_sources where origin = 'src1' or kind = 'paper'""")
def b04_metadata_any(t):
    return C.metadata_any(_with_metadata(t), _filters(t))


@query("""select doc_id, case when doc_id % 3 > 0 then 'source' end as key, case when doc_id % 3 > 0 then concat(source, case when doc_id % 3 = 2 then '=x' else '' end) end as value,
  case when doc_id % 3 = 0 then concat('no ''='' in ', source) end as error from documents""")
def b05_parse_filters(t):
    text = F.expr("case doc_id % 3 when 0 then source when 1 then concat(' source = ', source, ' ') else concat('source=', source, '=x') end")
    return t.documents.select("doc_id", C.parse_filter(text).alias("f")).select("doc_id", "f.key", "f.value", "f.error")


@query("select doc_id, case when doc_id % 4 < 2 then source end as key, case when doc_id % 4 < 2 then concat(lang, case when doc_id % 4 = 1 then ':x' else '' end) end as value from documents")
def b05_parse_pairs(t):
    text = F.expr("case doc_id % 4 when 0 then concat(' ', source, ' : ', lang) when 1 then concat(source, ':', lang, ':x') when 2 then concat(source, ': ') else source end")
    return t.documents.select("doc_id", C.parse_pair(text).alias("f")).select("doc_id", "f.key", "f.value")


@query("select job_id, status from m_jobs where status like 'failed:%'")
def b06_jobs_by_status(t):
    return C.jobs_by_status(t.m_jobs, "failed").select("job_id", "status")


@query("select job_id, status from m_jobs order by updated_at desc, job_id limit 50")
def b06_jobs_latest(t):
    return C.jobs_by_status(t.m_jobs).select("job_id", "status")


@query("select source_id, name from m_sources where not is_deleted order by created_at desc, source_id limit 25")
def b07_sources_last(t):
    return C.sources_last(t.m_sources, 25).select("source_id", "name")


@query("select source_id, name from m_sources where not is_deleted and created_at >= timestamp '2024-01-03 00:00:00'")
def b07_sources_since(t):
    return C.sources_last(t.m_sources, since="2024-01-03 00:00:00").select("source_id", "name")


@query("select source_id from m_sources where not is_deleted and kind = 'youtube'")
def b08_sources_of_kind(t):
    return C.sources_of_kind(t.m_sources, "youtube").select("source_id")


@query("""select doc_id, doc_id % 11 = 0 as heading_only from documents where text <> ''""")
def b09_is_heading_only(t):
    text = F.expr("case when doc_id % 11 = 0 then concat('## ', source, '\n\n# ', lang) else text end")
    return t.documents.where("text <> ''").select("doc_id", X.is_heading_only(text).alias("heading_only"))


@query("select doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as text from documents")
def b10_normalize_text(t):
    return t.documents.select("doc_id", X.normalize_text(F.col("text")).alias("text"))


@query("""with f as (select doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) as x from documents)
select doc_id, case when length(x) > 180 then concat(rtrim(substr(x, 1, 179)), '…') else x end as short,
  case when length(text) > 500 then concat(substr(text, 1, 500), '…') else text end as markdown from f""")
def b11_preview(t):
    return t.documents.select("doc_id", X.preview(F.col("text")).alias("short"), X.markdown_preview(F.col("text")).alias("markdown"))


@query("select doc_id, trim(text, ' \n') as text from (select doc_id, source as text from documents)")
def b12_strip_code_fences(t):
    return t.documents.select("doc_id", X.strip_code_fences(F.concat(F.lit("```json\n"), "source", F.lit("\n```"))).alias("text"))


@query("""select doc_id, regexp_replace(array_to_string(list_transform(string_split(concat(' ', replace(text, ' ', '  '), chr(10)), chr(10)), lambda x: regexp_replace(x, '\\s+$', '')), chr(10)), '^\\s+|\\s+$', '', 'g') as text from documents""")
def b13_normalize_markdown(t):
    return t.documents.select("doc_id", X.normalize_markdown(F.concat(F.lit(" "), F.replace("text", F.lit(" "), F.lit("  ")), F.lit("\n"))).alias("text"))


@query("select split_part(status, ':', 1) as status, count(*) as n from m_jobs group by 1")
def d01_job_stats(t):
    return C.job_stats(t.m_jobs)


@query("""with n as (select source_id, count(distinct insight_id) as n from m_vchunks join m_links using (chunk_id) where not is_deleted group by 1)
select s.source_id, s.name, s.created_at, coalesce(n.n, 0) as n_insights, (select count(*) from m_sources where not is_deleted) as total
from m_sources s left join n using (source_id) where not s.is_deleted order by created_at desc, source_id limit 20 offset 10""")
def d02_list_sources(t):
    return C.list_sources(t.m_sources, t.m_vchunks, t.m_links, 20, 10)


@query("""with n as (select source_id, count(distinct insight_id) as n from m_vchunks join m_links using (chunk_id) where not is_deleted group by 1)
select s.source_id, s.kind, coalesce(n.n, 0) as n_insights, case when coalesce(n.n, 0) > 0 then 'yes' else 'no' end as has_insights
from m_vsources s left join n using (source_id) where not s.is_deleted""")
def d03_source_summary(t):
    return C.source_summary(t.m_vsources, t.m_vchunks, t.m_links)


@query("""with i as (select insight_id, trim(regexp_replace(content, '\\s+', ' ', 'g')) as x from m_insights)
select c.source_id, l.insight_id, c.chunk_id, c.chunk_index, case when length(x) > 80 then concat(rtrim(substr(x, 1, 79)), '…') else x end as preview
from m_vchunks c join m_links l using (chunk_id) join i on i.insight_id = l.insight_id where not c.is_deleted""")
def d04_source_insights(t):
    return C.source_insights(t.m_vchunks, t.m_links, t.m_insights)


def _marked(t):
    return t.m_vchunks.withColumn(
        "content", F.expr("case when chunk_id % 11 = 0 then concat('## ', source_id) when chunk_id % 3 = 0 then concat(content, '<!-- image -->') else content end")
    )


@query("""select c.source_id, j.job_id, count(*) as n_chunks from m_vchunks c join m_jobs j on j.source_id = c.source_id
where not is_deleted and chunk_id % 11 = 0 and status = 'completed' group by all""")
def d05_heading_only_sources(t):
    return C.heading_only_sources(_marked(t), t.m_jobs)


@query("""select c.source_id, j.job_id, count(distinct chunk_id) as n_chunks from m_vchunks c join m_jobs j on j.source_id = c.source_id
where not is_deleted and chunk_id % 11 <> 0 and chunk_id % 3 = 0 and status = 'completed' group by all""")
def d06_image_placeholder_sources(t):
    return C.image_placeholder_sources(_marked(t), t.m_jobs)


@query("""with r as (select l.insight_id, c.source_id, concat('t', cast(c.source_id as varchar)) as a, concat('x', cast(l.chunk_id % 4 as varchar)) as b
  from m_links l join m_vchunks c on c.chunk_id = l.chunk_id join m_vsources s on s.source_id = c.source_id
  where not c.is_deleted and not s.is_deleted and s.job_status = 'completed'),
u as (select insight_id, source_id, a as topic from r union all select insight_id, source_id, b from r)
select insight_id, array_to_string(list_sort(list_distinct(list(topic))), ',') as topics, array_to_string(list_sort(list_distinct(list(source_id))), ',') as sources from u group by insight_id""")
def d07_insight_details(t):
    links = t.m_links.join(t.m_vchunks.select("chunk_id", "source_id"), "chunk_id").select(
        "chunk_id", "insight_id", F.array(F.concat(F.lit("t"), "source_id"), F.concat(F.lit("x"), F.col("chunk_id") % 4)).alias("topics")
    )
    d = C.insight_details(links, t.m_vchunks, t.m_vsources)
    return d.select("insight_id", F.array_join("topics", ",").alias("topics"), F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"))


@query("""select 'RELATED_TO' as type, (select count(*) from m_links where chunk_id <> insight_id) as n
union all select 'CONTAINS', (select count(*) from m_links where chunk_id = insight_id) union all select 'MENTIONED_IN', 0""")
def d08_edge_type_counts(t):
    edges = t.m_links.select(F.when(F.col("chunk_id") == F.col("insight_id"), "CONTAINS").otherwise("RELATED_TO").alias("type"))
    return C.edge_type_counts(edges, t.spark.createDataFrame([("RELATED_TO",), ("CONTAINS",), ("MENTIONED_IN",)], "type string"))


@query("""select s.source_id, coalesce(c.n, 0) as n_chunks, coalesce(m.e, 0) as n_entities, coalesce(m.k, 0) as n_graph_chunks from m_vsources s
left join (select source_id, count(*) as n from m_vchunks group by 1) c using (source_id)
left join (select source_id, count(distinct entity_id) as e, count(distinct chunk_id) as k from m_mentions group by 1) m using (source_id)""")
def d09_artifact_counts(t):
    return C.artifact_counts(t.m_vsources, t.m_vchunks, t.m_mentions)
