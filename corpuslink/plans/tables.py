"""The tables that the registered queries run on: the given ones, and model tables that Spark derives from them.

The same text defines a model table for Spark and for the SQL that checks a query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

MODEL = {
    "m_sources": """select d.doc_id as source_id, concat('doc-', cast(d.doc_id as varchar(20))) as name, md5(d.text) as md5, d.text as content,
        d.lang, d.source as origin, case d.doc_id % 4 when 0 then 'report' when 1 then 'article' when 2 then 'youtube' else 'paper' end as kind,
        e.ts as created_at, (d.doc_id % 50 = 7) as is_deleted, 'completed' as job_status
        from documents d join events e on e.event_id = d.doc_id""",
    "m_job_events": """select event_id, user_id as job_id, ts as updated_at,
        case event_id % 8 when 0 then 'parsing' when 1 then 'profiling' when 2 then 'chunking' when 3 then 'validation'
          when 4 then 'embedding' when 5 then 'graph_extraction' when 6 then 'graph_linking' else 'insight_extraction' end as stage,
        case event_type when 'purchase' then 'completed' when 'error' then 'failed' when 'view' then 'processing'
          when 'click' then 'pending' else 'cancelled' end as state
        from events""",
    "m_jobs": """select event_id as job_id, event_id % 500 as source_id, updated_at, stage as current_stage,
        case when state in ('failed', 'processing') then concat(state, ':', stage) else state end as status from m_job_events""",
    "m_vchunks": """select v.vec_id as chunk_id, cast(v.label as bigint) as source_id,
        cast(row_number() over (partition by v.label order by v.vec_id) - 1 as int) as chunk_index,
        d.text as content, v.embedding, (v.vec_id % 40 = 3) as is_deleted
        from embeddings v join documents d on d.doc_id = v.vec_id""",
    "m_vsources": """select distinct cast(label as bigint) as source_id, case when label % 2 = 0 then 'report' else 'article' end as kind,
        case when label % 3 = 0 then 'en' else 'de' end as lang, (label = 9) as is_deleted,
        case when label = 8 then 'failed:embedding' else 'completed' end as job_status from embeddings""",
    "m_mentions": """select distinct l.l_orderkey as chunk_id, o.o_custkey as source_id, l.l_partkey as entity_id,
        p.p_name as canonical_name, p.p_type as entity_type
        from lineitem l join orders o on o.o_orderkey = l.l_orderkey join part p on p.p_partkey = l.l_partkey""",
    "m_links": """select vec_id as chunk_id, vec_id as insight_id from embeddings
        union select vec_id as chunk_id, cast(floor(vec_id / 2) as bigint) as insight_id from embeddings""",
    "m_insights": """select v.vec_id as insight_id, d.text as content, v.embedding from embeddings v join documents d on d.doc_id = v.vec_id""",
    "m_queries": """select cast(query_id as bigint) as query_id, text from (values (0, 'that with'), (1, 'this from'), (2, 'than'), (3, 'ther tion'), (4, 'thre')) as t(query_id, text)""",
}


def _used(sql: str) -> list[str]:
    """Model tables that a text needs, each after those it needs itself."""
    out: list[str] = []
    for name in MODEL:
        if re.search(rf"\b{name}\b", sql):
            out += [x for x in [*_used(MODEL[name]), name] if x not in out]
    return out


def with_models(sql: str) -> str:
    """The text with the model tables it needs in front."""
    parts = ", ".join(f"{name} as ({MODEL[name]})" for name in _used(sql))
    if not parts:
        return sql
    m = re.match(r"\s*with(\s+recursive)?\s", sql, re.I)
    return f"with{m[1] or ''} {parts}, {sql[m.end():]}" if m else f"with {parts} {sql}"


class Tables:
    """Attribute access to the tables below a folder: t.documents, t.m_sources."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in GIVEN:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in MODEL:
            raise AttributeError(name)
        return self.sql(MODEL[name])

    def sql(self, text: str) -> DataFrame:
        names = [n for n in [*GIVEN, *MODEL] if re.search(rf"\b(?:from|join)\s+{n}\b", text)]
        for n in names:
            text = re.sub(rf"\b(from|join)(\s+){n}\b", rf"\1\2{{{n}}}", text)
        return self.spark.sql(text, **{n: getattr(self, n) for n in names}) if names else self.spark.sql(text)
