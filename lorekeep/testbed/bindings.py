"""The engine's raw inputs as views over the driver tables.

Each text below is plain SQL that Spark and DuckDB both run; the registry uses it for the Spark
side and, as leading CTEs, for the oracle.  Bad rows, repeated ids, unknown parents and a topic
holding a third of all knowledge are put in on purpose.  Every view covers its whole table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep import schemas as S
from lorekeep.operators.joins import broadcast_limit, decoded_bytes

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS: dict[str, str] = {
    # Topics: one per part; a brand is a category, some categories have a single topic.
    "b_t1": """
        select p_partkey, p_size, cast(p_partkey as string) topic_id,
          case when p_partkey%61=7 then ' ' else p_name end topic_name,
          case when p_partkey%29=4 then p_brand||'/'||cast(p_partkey as string) else p_brand end parent_category,
          p_type description
        from part""",
    "b_topics": """
        select topic_id, topic_name, parent_category, description from b_t1
        union all select topic_id, topic_name, parent_category, 'again' from b_t1 where p_size = 50""",
    "b_sources": """
        select cast(s_suppkey as string) source_id, s_name source_name,
          'type_'||cast(s_nationkey%3 as string) source_type,
          (case when s_suppkey%25=0 then 'http://' else 'https://' end)||'example.org/'||cast(s_suppkey as string) url,
          case when s_suppkey%40=7 then 'RETIRED' when s_suppkey%10=3 then 'INACTIVE' else 'ACTIVE' end source_status
        from supplier""",
    "b_k1": """
        select d.doc_id, l.quality, l.toxic, 'know_'||cast(d.doc_id as string) knowledge_id,
          case when d.doc_id%3=0 then '42' when d.doc_id%3=1 then cast(d.doc_id%211 as string)
            else cast(d.doc_id%2003 as string) end topic_id,
          case when d.doc_id%53=7 then 'missing' else cast(d.doc_id%11 as string) end source_id,
          case when d.doc_id%71=4 then '  ' else d.lang||' note '||d.source end title, d.text summary,
          case when l.toxic=1 then 'EXPIRED' when l.quality=0 then 'NEEDS_REVIEW'
            when l.quality is null and d.doc_id%7=0 then 'PENDING' else 'APPROVED' end review_status,
          case when d.doc_id%97=5 then 'ARCHIVED' when d.doc_id%10=0 then 'STALE' else 'CURRENT' end content_status,
          case when d.doc_id%89=3 then 'some day'
            else cast(date '2024-01-01' + cast(d.doc_id%365 as integer) as string) end published_date,
          '2025-06-01' last_reviewed_date,
          case when d.doc_id%83=6 then 'v1' else cast(1+d.doc_id%4 as string) end content_version
        from documents d left join labels l on d.doc_id=l.doc_id""",
    # A second delivery repeats the toxic, low-quality documents.
    "b_knowledge": """
        select knowledge_id, topic_id, source_id, title, summary, review_status, content_status,
          published_date, last_reviewed_date, content_version from b_k1
        union all
        select knowledge_id, topic_id, source_id, title, summary, review_status, content_status,
          published_date, last_reviewed_date, '9' from b_k1 where toxic=1 and quality=0""",
    "b_reviews": """
        select 'rev_'||cast(doc_id as string) review_id,
          case when doc_id%60=1 then 'know_missing' else 'know_'||cast(doc_id as string) end knowledge_id,
          'role_'||cast(doc_id%3 as string) reviewer_role,
          case when doc_id%67=5 then '01/06/2025' else '2025-06-01' end review_date,
          case when toxic=1 then 'EXPIRED' when quality=0 then 'NEEDS_REVIEW'
            when doc_id%41=2 then 'MAYBE' else 'APPROVED' end review_status,
          cast(null as string) notes
        from labels""",
    "b_events": """
        select cast(event_id as string) event_id,
          case event_type when 'view' then 'QUESTION_ASKED' when 'purchase' then 'RESPONSE_GENERATED'
            when 'click' then 'SOURCE_OPENED' when 'signup' then 'FEEDBACK_SUBMITTED'
            when 'error' then case when event_id%3=0 then 'PAGE_PRINTED' else 'RELATED_TOPIC_OPENED' end
          end event_type,
          case when event_id%101=1 then '' else 'user_'||cast(user_id as string) end session_id,
          'trace_'||cast(event_id as string) trace_id,
          case when event_type in ('click','error') then
            case when event_id%3=1 then '42' else cast(event_id%211 as string) end end topic_id,
          case when event_type='click' then 'know_'||cast(event_id%1000 as string) end knowledge_id,
          case when event_type='signup' then case when event_id%29=3 then 'undecided'
            when event_id%5=0 then 'down' else 'up' end end rating,
          case when event_type='purchase' then value end latency_ms,
          case when event_type='purchase' then cast(event_id%3+1 as integer) end source_count,
          ts occurred_at
        from events""",
    # The vector index is a snapshot of all documents that have a vector, eligible now or not.
    "b_embeddings": """
        select k.knowledge_id, k.topic_id, k.title, k.summary, e.embedding
        from embeddings e join b_k1 k on e.vec_id=k.doc_id""",
    "b_questions": """
        select 'q_'||cast(b.item_id as string) query_id, b.text question, e.embedding
        from benchmark b join embeddings e on e.vec_id=b.item_id""",
}


def with_clause(text: str, views: dict[str, str] = VIEWS) -> str:
    """``with ... as (...)`` holding every view that ``text`` reads, directly or through others."""
    order: list[str] = []

    def add(sql: str) -> None:
        for name in re.findall(r"\b[a-z]+_[a-z0-9_]+\b", sql):
            if name in views and name not in order:
                add(views[name])
                order.append(name)

    add(text)
    return "with " + ", ".join(f"{v} as ({views[v]})" for v in order) + " " if order else ""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, text: str, frames: dict[str, DataFrame]) -> DataFrame:
    """``text`` over ``frames``, registered under names of their own so no view of the caller's is
    replaced."""
    def rename(match: re.Match) -> str:
        if match[2] not in frames:
            return match[0]
        frames[match[2]].createOrReplaceTempView(f"lorekeep_{match[2]}")
        return f"{match[1]} lorekeep_{match[2]}"

    return spark.sql(re.sub(r"\b(from|join)\s+([a-z]+)\b", rename, text))


def tables_of(view: str) -> list[str]:
    text = with_clause(view)
    return [name for name in TABLES if re.search(rf"\b{name}\b", text)]


def bind(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """The view as a DataFrame over the tables of ``sf_dir``."""
    if view == "b_knowledge":  # both deliveries in one pass, so texts meet their labels once
        rows, version = bind(spark, sf_dir, "b_k1"), F.col("content_version")
        again = (F.col("toxic") == 1) & (F.col("quality") == 0)
        versions = F.when(again, F.array(version, F.lit("9"))).otherwise(F.array(version))
        return rows.withColumn("content_version", F.explode(versions)).select(*S.RAW_KNOWLEDGE.names)
    frames = {name: table(spark, sf_dir, name) for name in tables_of(view)}
    if view == "b_embeddings":  # texts without a vector drop out before anything shuffles
        ids = frames["embeddings"].select(F.col("vec_id").alias("doc_id")).distinct()
        if decoded_bytes(ids) <= broadcast_limit(ids):
            frames["documents"] = frames["documents"].join(F.broadcast(ids), "doc_id", "left_semi")
    return run_sql(spark, f"{with_clause(view)}select * from {view}", frames)
