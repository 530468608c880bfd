"""Queries over chunks and over what models answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import token_count
from ..operators import chunking as K
from ..operators import responses as R

QUERIES: dict = {}
SQL: dict[str, str] = {}
TOKENS = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'))"


def query(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f
    return take


@query(f"select doc_id, {TOKENS.format('text')} as n_tokens from documents")
def t01_token_count(t):
    return t.documents.select("doc_id", token_count(F.col("text")).cast("long").alias("n_tokens"))


_PROFILE = """named_struct('structure_type', element_at(array('well-structured', 'loosely-structured', 'unstructured'), cast(doc_id % 3 + 1 as int)),
  'heading_consistency', if(doc_id % 4 < 3, 'consistent', 'inconsistent'), 'content_density', if(doc_id % 7 = 0, 'variable', 'uniform'),
  'primary_content_type', case source when 'src1' then 'transcript' when 'src2' then 'qa_pairs' else 'prose' end, 'avg_section_length', if(doc_id % 5 = 0, 'long', 'medium'))"""


@query("""select doc_id, case when doc_id % 3 = 0 and doc_id % 4 < 3 then 'markdown_header' when source in ('src1', 'src2') then 'semantic'
  when doc_id % 3 = 2 and doc_id % 7 <> 0 then 'recursive' else 'semantic' end as strategy from documents""")
def t02_select_strategy(t):
    return t.documents.select("doc_id", K.select_strategy(F.expr(_PROFILE)).alias("strategy"))


def _semantic_sql(docs: str) -> str:
    n = TOKENS.format("t")
    return f"""with recursive s as (select doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\\s+', concat('\\1', chr(31)), 'g'), concat(chr(31), '|\\n{{2,}}')),
  lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as a from {docs}),
u as (select doc_id, unnest(range(len(a))) as i, unnest(a) as t from s), z as (select *, {n} as n from u),
r as (select doc_id, i, 0 as c, n as run from z where i = 0 union all
  select z.doc_id, z.i, case when r.run > 0 and r.run + z.n > 400 then r.c + 1 else r.c end, case when r.run > 0 and r.run + z.n > 400 then z.n else r.run + z.n end
  from r join z on z.doc_id = r.doc_id and z.i = r.i + 1),
o as (select r.doc_id, r.c as chunk_index, string_agg(z.t, ' ' order by r.i) as content from r join z using (doc_id, i) group by r.doc_id, r.c)
select doc_id, chunk_index, content, cast({TOKENS.format('content')} as int) as token_count from o"""


@query(_semantic_sql("documents"))
def t03_split_semantic(t):
    return K.semantic_chunks(t.documents)


@query()
def t04_split_recursive(t):
    return K.recursive_chunks(t.documents)


def _headed(t):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 7 < 3, F.concat(F.repeat(F.lit("#"), i % 7 + 1), F.lit(" "), x)).otherwise(x))
    return t.documents.select("doc_id", F.array_join(lines, "\n").alias("text"), "lang", "source")


@query()
def t05_split_markdown_headers(t):
    return K.markdown_chunks(_headed(t))


@query()
def t06_chunk_documents(t):
    return K.chunk_documents(_headed(t).withColumn("profile", F.expr(_PROFILE)))


@query()
def t07_chunk_hierarchical(t):
    return K.hierarchical_chunks(_headed(t).withColumn("strategy", K.select_strategy(F.expr(_PROFILE))))


_DOMAIN = "case chunk_id % 3 when 0 then 'legal' when 1 then 'general' else 'medical' end"


@query(f"""with p as (select chunk_id, unnest([0, 1]) as pos from m_vchunks where chunk_id % 5 < 3),
b as (select source_id, chunk_id, chunk_index, -1 as pos, content from m_vchunks
  union all select source_id, c.chunk_id, chunk_index, p.pos, concat('p', p.pos, ' of ', c.chunk_id) from m_vchunks c join p using (chunk_id) where {_DOMAIN} in ('legal', 'medical'))
select source_id, cast(row_number() over (partition by source_id order by chunk_index, pos) - 1 as int) as chunk_index, case when pos >= 0 then chunk_id end as parent_chunk_id, content from b""")
def t08_expand_propositions(t):
    props = t.m_vchunks.where("chunk_id % 5 < 3").selectExpr("chunk_id", "explode(array(0, 1)) as pos").selectExpr("chunk_id", "pos", "concat('p', pos, ' of ', chunk_id) as proposition")
    return K.expand_propositions(t.m_vchunks.withColumn("domain", F.expr(_DOMAIN)), props)


_RATE = "case when source_id % 3 = 0 then 0.25 when source_id % 3 = 1 then 0.1 else 1.0 end"


@query(f"""with n as (select *, greatest(1, ceil(count(*) over (partition by source_id) * {_RATE})) as n,
  row_number() over (partition by source_id order by md5(concat('v1', chunk_id)), chunk_id) as k from m_vchunks)
select chunk_id, source_id from n where k <= n""")
def t09_sample_for_validation(t):
    return K.sample_for_validation(t.m_vchunks, F.expr(_RATE)).select("chunk_id", "source_id")


@query("""select source_id, count(*) as n_sampled, count(*) filter (where chunk_id % 4 = 0) as n_failed,
  count(*) filter (where chunk_id % 4 = 0) > 0.2 * count(*) as fails from m_vchunks where chunk_id % 2 = 0 or chunk_id % 7 = 0 group by 1""")
def t10_validation_verdict(t):
    verdicts = t.m_vchunks.where("chunk_id % 3 < 2 or chunk_id % 4 = 0").selectExpr("chunk_id", "chunk_id % 4 <> 0 as pass")
    return K.validation_verdict(t.m_vchunks.where("chunk_id % 2 = 0 or chunk_id % 7 = 0"), verdicts)


@query("select doc_id, concat('Language: ', lang, '. Text: ', substr(text, 1, 300), ' (', source, ')') as prompt from documents")
def t11_build_prompt(t):
    return t.documents.select("doc_id", K.build_prompt("Language: {lang}. Text: {text} ({source})", {"lang": (F.col("lang"), None), "source": (F.col("source"), None), "text": (F.col("text"), 300)}).alias("prompt"))


@query("""select source, concat('Answer from the results.', chr(10), chr(10), 'Question: What is in ', source, '?', chr(10), chr(10), '```json', chr(10),
  to_json(list({'doc_id': doc_id, 'lang': lang} order by doc_id)), chr(10), '```') as prompt
from documents group by source""")
def t12_answer_context(t):
    """The answer for each source names all its results."""
    return K.answer_contexts(t.documents, "source", F.concat(F.lit("What is in "), "source", F.lit("?")), ("doc_id", "lang"), "Answer from the results.", None, ("doc_id",))


@query("""select source_id as community, string_agg(concat('[Source: s', source_id, ']', chr(10), content), concat(chr(10), chr(10), '---', chr(10), chr(10)) order by chunk_index) as context
from m_vchunks where chunk_index < 5 group by 1""")
def t13_community_context(t):
    rows = t.m_vchunks.selectExpr("source_id as community", "chunk_index as rank", "concat('s', source_id) as source_name", "content")
    return K.community_context(rows)


def _answer(json):
    """An answer as models give it: fenced for even ids, cut off for every thirteenth."""
    said = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```json\n"), json, F.lit("\n```"))).otherwise(json)
    return F.when(F.col("doc_id") % 13 == 0, F.substring(json, 1, 12)).otherwise(said)


@query("""select doc_id, source as name, lang as type, source as alias from documents where doc_id % 13 <> 0
union all select doc_id, lang, 'language', null from documents where doc_id % 13 <> 0""")
def r01_parse_entities(t):
    one = F.struct(F.col("source").alias("name"), F.col("lang").alias("type"), F.array("source").alias("aliases"))
    items = F.concat(F.lit('["noise", '), F.to_json(one), F.lit(', {"name": "'), "lang", F.lit('", "type": "language"}]'))
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"entities": '), items, F.lit("}"))).otherwise(items)
    return t.documents.select("doc_id", F.explode(R.parse_entities(_answer(said))).alias("e")).select("doc_id", "e.name", "e.type", F.get("e.aliases", F.lit(0)).alias("alias"))


@query("select doc_id, source, lang as target, 'IN' as type, (doc_id % 100) / 100.0::double as confidence from documents where doc_id % 13 <> 0 and doc_id % 100 >= 75")
def r02_parse_relationships(t):
    one = F.struct(F.col("source").alias("source"), F.col("lang").alias("target"), F.lit("IN").alias("type"), (F.col("doc_id") % 100 / 100).alias("confidence"))
    rows = F.explode(R.parse_relationships(_answer(F.concat(F.lit("["), F.to_json(one), F.lit(', {"source": "x", "target": "y"}]')))))
    return t.documents.select("doc_id", rows.alias("e")).select("doc_id", "e.source", "e.target", "e.type", "e.confidence")


@query("select doc_id, concat('About ', source) as insight, case when doc_id % 5 = 0 then '' else lang end as topics from documents where doc_id % 13 <> 0")
def r03_parse_insights(t):
    topics = F.when(F.col("doc_id") % 5 == 0, F.lit('"none"')).otherwise(F.concat(F.lit('[" '), "lang", F.lit(' ", ""]')))
    said = F.concat(F.lit('{"insights": [{"insight": " About '), "source", F.lit(' ", "topics": '), topics, F.lit('}, {"insight": "  "}, "noise"]}'))
    return t.documents.select("doc_id", F.explode(R.parse_insights(_answer(said))).alias("e")).select("doc_id", "e.insight", F.array_join("e.topics", ",").alias("topics"))


@query("""select doc_id, case when doc_id % 13 = 0 then 'general' else source end as domain, case when doc_id % 13 = 0 then 'unstructured' else lang end as structure_type, 'none' as heading_consistency,
  'uniform' as content_density, 'prose' as primary_content_type, case when doc_id % 13 = 0 then 'medium' else 'long' end as avg_section_length, doc_id % 13 <> 0 and lang = 'en' as has_tables,
  false as has_code_blocks from documents""")
def r04_parse_profile(t):
    said = F.to_json(F.struct(F.col("source").alias("domain"), F.col("lang").alias("structure_type"), F.lit("long").alias("avg_section_length"), (F.col("lang") == "en").alias("has_tables")))
    return t.documents.select("doc_id", R.parse_profile(_answer(said)).alias("p")).select("doc_id", "p.*")


@query("select doc_id, case when doc_id % 13 <> 0 then lang end as kind, case when doc_id % 13 <> 0 then source end as source, case when doc_id % 13 <> 0 then 2 else 0 end as n from documents")
def r05_parse_metadata(t):
    said = F.to_json(F.struct(F.col("lang").alias("kind"), F.col("source").alias("source"), F.lit("x").alias("other")))
    m = t.documents.select("doc_id", R.parse_metadata(_answer(said)).alias("m"))
    return m.select("doc_id", F.try_element_at("m", F.lit("kind")).alias("kind"), F.try_element_at("m", F.lit("source")).alias("source"), F.size("m").alias("n"))


@query("select doc_id, doc_id % 13 = 0 or doc_id % 5 <> 0 as pass from documents")
def r06_parse_verdict(t):
    said = F.when(F.col("doc_id") % 7 == 0, F.when(F.col("doc_id") % 5 == 0, F.lit('{"pass": false}')).otherwise(F.lit('{"why": "x"}'))).otherwise(F.to_json(F.struct((F.col("doc_id") % 5 != 0).alias("pass"))))
    return t.documents.select("doc_id", R.parse_verdict(_answer(said)).alias("pass"))


def _variants(t):
    made = [("original", 0, "source"), ("hyde", 0, "concat('A text on ', source)"), ("expanded", 0, "concat(' ', upper(source), '  ')"), ("step_back", 0, "' '"), ("decomposed", 0, "source"), ("decomposed", 1, "concat(lang, ' of ', source)")]
    kinds = ", ".join(f"named_struct('name', '{n}', 'pos', {p}, 'text', {x})" for n, p, x in made)
    return t.documents.selectExpr("doc_id as query_id", f"explode(array({kinds})) as v").select("query_id", "v.name", "v.pos", "v.text")


@query("""select doc_id as query_id, 'original' as name, 0 as pos, source as text from documents union all select doc_id, 'hyde', 0, concat('A text on ', source) from documents
union all select doc_id, 'decomposed', 1, concat(lang, ' of ', source) from documents""")
def r07_normalize_variants(t):
    return R.normalize_variants(_variants(t))


@query("""select doc_id as query_id, unnest(['original', 'hyde', 'decomposed']) as name, unnest([1.0, 0.65, 1.0]::double[]) as weight from documents""")
def r08_variant_weights(t):
    return R.normalize_variants(_variants(t)).select("query_id", "name", R.variant_weight(F.col("name")).alias("weight"))


@query("""with c as (select source_id as group_id, chunk_index as rank, concat('n', chunk_id) as name from m_vchunks),
k as (select *, row_number() over (partition by group_id order by rank, name) as k from c where group_id % 2 = 1 or substr(name, 2)::int % 3 = 0)
select group_id, name, cast(k as int) as place from k where k <= 5""")
def r09_select_names(t):
    c = t.m_vchunks.selectExpr("source_id as group_id", "chunk_index as rank", "concat('n', chunk_id) as name")
    return R.select_names(c, c.where("group_id % 2 = 0 and cast(substring(name, 2) as int) % 3 = 0").select("group_id", "name"), 5)
