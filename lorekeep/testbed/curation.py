"""Scans, sinks, quality rules, curation and catalog reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep import schemas as S
from lorekeep.functions.iso import iso_date, iso_timestamp
from lorekeep.functions.governance import ai_eligible
from lorekeep.operators import curate, quality, reports, seed_gate
from lorekeep.operators.joins import keep_matching, sized_join
from lorekeep.plans.refresh import Refresh
from lorekeep.sources import files
from lorekeep.testbed.registry import SQL_VIEWS, Context, dates_as_text, query, six


def _blank(column: str) -> str:
    return f"coalesce(regexp_full_match({column}, '\\s*'), true)"


def _missing(required: list[str]) -> str:
    return "concat_ws(', ', " + ", ".join(f"case when {_blank(c)} then '''{c}''' end" for c in required) + ")"


_DUP = "when n > 1 then 'duplicate id: '||cast(n as varchar)||' rows share this identifier'"
_MISS = "when miss <> '' then 'missing required fields: ['||miss||']'"

SQL_VIEWS.update({
    "c_topics": f"""
        select topic_id, topic_name, parent_category, description, case {_DUP} {_MISS} end reason
        from (select *, count(*) over (partition by topic_id) n, {_missing(S.TOPIC_REQUIRED)} miss from b_topics)""",
    "c_sources": f"""
        select source_id, source_name, source_type, url, source_status, case {_DUP} {_MISS}
          when source_status not in ('ACTIVE','INACTIVE') then 'invalid source_status '''||source_status||''''
          when not starts_with(url, 'https://') then 'url is not https: '''||url||'''' end reason
        from (select *, count(*) over (partition by source_id) n, {_missing(S.SOURCE_REQUIRED)} miss from b_sources)""",
    "v_topics": "select * from c_topics where reason is null",
    "v_sources": "select * from c_sources where reason is null",
    "c_knowledge": f"""
        select knowledge_id, topic_id, source_id, title, summary, review_status, content_status, published_date,
          last_reviewed_date, content_version, topic_name, source_name,
          review_status='APPROVED' and source_status='ACTIVE' and content_status='CURRENT' ai_eligible,
          case {_DUP} {_MISS}
            when topic_name is null then 'unknown topic_id '''||topic_id||''''
            when source_status is null then 'unknown source_id '''||source_id||''''
            when review_status not in ('APPROVED','NEEDS_REVIEW','EXPIRED') then 'invalid review_status '''||review_status||''''
            when content_status not in ('CURRENT','STALE') then 'invalid content_status '''||content_status||''''
            when try_cast(published_date as date) is null then 'unparseable published_date '''||published_date||''''
            when try_cast(last_reviewed_date as date) is null then 'unparseable last_reviewed_date '''||last_reviewed_date||''''
            when not regexp_full_match(content_version, '[+-]?[0-9]+') then 'invalid content_version '''||content_version||''''
          end reason
        from (select k.*, t.topic_name, s.source_name, s.source_status,
            count(*) over (partition by k.knowledge_id) n, {_missing(["k." + c for c in S.KNOWLEDGE_REQUIRED]).replace("'''k.", "'''")} miss
          from b_knowledge k left join v_topics t on k.topic_id=t.topic_id
          left join v_sources s on k.source_id=s.source_id)""",
    "v_catalog": """
        select knowledge_id, topic_id, topic_name, source_id, source_name, title, summary, review_status,
          content_status, ai_eligible, cast(published_date as date) published_date,
          cast(last_reviewed_date as date) last_reviewed_date, cast(content_version as bigint) content_version
        from c_knowledge where reason is null""",
    "v_eligible": "select knowledge_id, topic_id, title, summary from v_catalog where ai_eligible",
    "c_reviews": f"""
        select review_id, knowledge_id, reviewer_role, review_date, review_status, notes, case {_DUP} {_MISS}
          when not known then 'unknown knowledge_id '''||knowledge_id||''''
          when review_status not in ('APPROVED','NEEDS_REVIEW','EXPIRED') then 'invalid review_status '''||review_status||''''
          when try_cast(review_date as date) is null then 'unparseable review_date '''||review_date||'''' end reason
        from (select r.*, k.knowledge_id is not null known, count(*) over (partition by review_id) n,
            {_missing(["r." + c for c in S.REVIEW_REQUIRED]).replace("'''r.", "'''")} miss
          from b_reviews r left join v_catalog k on r.knowledge_id=k.knowledge_id)""",
    "v_summary": """
        select topic_id, min(topic_name) topic_name, count(*) total_count,
          count(*) filter (ai_eligible) eligible_count,
          count(*) filter (review_status='APPROVED') approved_count,
          count(*) filter (review_status='NEEDS_REVIEW') needs_review_count,
          count(*) filter (review_status='EXPIRED') expired_count,
          count(*) filter (content_status='STALE') stale_count
        from v_catalog group by topic_id""",
    "v_quarantine": """
        select 'raw_topics' "table", reason, to_json({'topic_id': topic_id, 'topic_name': topic_name,
          'parent_category': parent_category, 'description': description})::varchar "row"
        from c_topics where reason is not null
        union all select 'raw_sources', reason, to_json({'source_id': source_id, 'source_name': source_name,
          'source_type': source_type, 'url': url, 'source_status': source_status})::varchar
        from c_sources where reason is not null
        union all select 'raw_knowledge', reason, to_json({'knowledge_id': knowledge_id, 'topic_id': topic_id,
          'source_id': source_id, 'title': title, 'summary': summary, 'review_status': review_status,
          'content_status': content_status, 'published_date': published_date,
          'last_reviewed_date': last_reviewed_date, 'content_version': content_version})::varchar
        from c_knowledge where reason is not null
        union all select 'raw_reviews', reason, to_json({'review_id': review_id, 'knowledge_id': knowledge_id,
          'reviewer_role': reviewer_role, 'review_date': review_date, 'review_status': review_status,
          'notes': notes})::varchar
        from c_reviews where reason is not null""",
    # What the pre-load gate finds; foreign keys go against the ids as delivered.
    "g_repeats": """
        select 'topics' "table", topic_id id, 'duplicate topic_id '''||topic_id||'''' error
        from (select topic_id, row_number() over (partition by topic_id) rn from b_topics) where rn > 1
        union all select 'sources', source_id, 'duplicate source_id '''||source_id||''''
        from (select source_id, row_number() over (partition by source_id) rn from b_sources) where rn > 1
        union all select 'knowledge', knowledge_id, 'duplicate knowledge_id '''||knowledge_id||''''
        from (select knowledge_id, row_number() over (partition by knowledge_id) rn from b_knowledge) where rn > 1
        union all select 'reviews', review_id, 'duplicate review_id '''||review_id||''''
        from (select review_id, row_number() over (partition by review_id) rn from b_reviews) where rn > 1""",
    "g_errors": f"""
        select * from g_repeats
        union all select 'sources', source_id, 'invalid source_status '''||source_status||'''' from b_sources
          where source_status not in ('ACTIVE','INACTIVE')
        union all select 'sources', source_id, 'url is not https '''||url||'''' from b_sources where not starts_with(url, 'https://')
        union all select 'knowledge', knowledge_id, 'unknown topic_id '''||topic_id||'''' from b_knowledge
          where topic_id not in (select topic_id from b_topics)
        union all select 'knowledge', knowledge_id, 'unknown source_id '''||source_id||'''' from b_knowledge
          where source_id not in (select source_id from b_sources)
        union all select 'knowledge', knowledge_id, 'invalid review_status '''||review_status||'''' from b_knowledge
          where review_status not in ('APPROVED','NEEDS_REVIEW','EXPIRED')
        union all select 'knowledge', knowledge_id, 'invalid content_status '''||content_status||'''' from b_knowledge
          where content_status not in ('CURRENT','STALE')
        union all select 'knowledge', knowledge_id, 'unparseable published_date '''||published_date||'''' from b_knowledge
          where try_cast(published_date as date) is null
        union all select 'knowledge', knowledge_id, 'unparseable last_reviewed_date '''||last_reviewed_date||'''' from b_knowledge
          where try_cast(last_reviewed_date as date) is null
        union all select 'knowledge', knowledge_id, 'empty summary' from b_knowledge where {_blank("summary")}
        union all select 'knowledge', knowledge_id, 'content_version is not an integer '''||content_version||''''
          from b_knowledge where not regexp_full_match(content_version, '[+-]?[0-9]+')
        union all select 'reviews', review_id, 'unknown knowledge_id '''||knowledge_id||'''' from b_reviews
          where knowledge_id not in (select knowledge_id from b_knowledge)
        union all select 'reviews', review_id, 'invalid review_status '''||review_status||'''' from b_reviews
          where review_status not in ('APPROVED','NEEDS_REVIEW','EXPIRED')""",
})

_CATALOG = """
    select * replace (cast(published_date as varchar) as published_date,
      cast(last_reviewed_date as varchar) as last_reviewed_date) from v_catalog"""


# ---- scans -------------------------------------------------------------------------------------

@query("scan_csv", """
    select knowledge_id, topic_id, source_id, title, summary, review_status, content_status, published_date,
      last_reviewed_date, content_version from b_knowledge""")
def scan_csv(c: Context) -> DataFrame:
    path = c.scratch("knowledge_csv")
    files.write_csv(c.raw("b_knowledge"), path)
    return files.read_csv(c.spark, path, S.RAW_KNOWLEDGE)


@query("scan_cast_on_load", "select doc_id, cast(cast(n_chars as varchar) as bigint) n_chars from documents")
def scan_cast_on_load(c: Context) -> DataFrame:
    text = c.table("documents").select("doc_id", F.col("n_chars").cast("string").alias("n_chars"))
    return files.cast_on_load(text, ["n_chars"])


@query("scan_raw_table", "select * from documents")
def scan_raw_table(c: Context) -> DataFrame:
    return files.read_table(c.spark, c.sf_dir, "documents.parquet")


@query("scan_param_query", "select * from b_sources where source_status = 'ACTIVE' and source_id <> '1'")
def scan_param_query(c: Context) -> DataFrame:
    return files.param_query(
        c.spark, "select * from {sources} where source_status = :status and source_id <> :id",
        {"status": "ACTIVE", "id": "1"}, sources=c.raw("b_sources"),
    )


@query("scan_lexical_corpus", "select knowledge_id, topic_id, title, summary from v_eligible where topic_id = '42'")
def scan_lexical_corpus(c: Context) -> DataFrame:
    return files.lexical_corpus(c.refresh.eligible, topic="42")


@query("scan_embedding_corpus", """
    select knowledge_id, topic_id, title, summary, round(list_sum(cast(embedding as double[])), 4) total
    from b_embeddings""")
def scan_embedding_corpus(c: Context) -> DataFrame:
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return files.embedding_corpus(c.embeddings, topic="").select(
        "knowledge_id", "topic_id", "title", "summary", F.round(total, 4).alias("total")
    )


@query("scan_file_arrival", """
    select 'RAW_FILE_ARRIVED' event_type, 'pages' bucket, url object_name,
      case when page_id%3=0 then null else 'text/html' end content_type,
      case when page_id%5=0 then null else cast(length(html) as bigint) end size_bytes,
      cast(null as varchar) time_created
    from pages""")
def scan_file_arrival(c: Context) -> DataFrame:
    pages = c.table("pages")
    notes = pages.select(
        F.lit("pages").alias("bucket"), F.col("url").alias("name"),
        F.when(F.col("page_id") % 3 != 0, F.lit("text/html")).alias("contentType"),
        F.when(F.col("page_id") % 5 != 0, F.length("html").cast("string")).alias("size"),
        F.lit(None).cast("string").alias("timeCreated"),
    )
    return files.file_signals(notes)


# ---- sinks -------------------------------------------------------------------------------------

@query("sink_full_refresh", _CATALOG)
def sink_full_refresh(c: Context) -> DataFrame:
    """A whole run: checks, quarantine and all eight tables; the catalog is read back."""
    warehouse = c.scratch("warehouse")
    c.new_refresh().run(warehouse, c.scratch("quarantine"))
    return dates_as_text(files.read_table(c.spark, warehouse, "semantic/knowledge_catalog", S.CATALOG))


@query("sink_load_truncate", "select * from b_reviews")
def sink_load_truncate(c: Context) -> DataFrame:
    base = c.scratch("raw")
    for _ in range(2):  # the second load replaces the first
        files.overwrite_table(c.raw("b_reviews"), base, "raw_reviews")
    return files.read_table(c.spark, base, "raw_reviews", S.RAW_REVIEWS)


@query("sink_quarantine_jsonl", """
    select "table", reason, json_extract_string("row", '$.knowledge_id') knowledge_id,
      json_extract_string("row", '$.summary') summary, json_extract_string("row", '$.published_date') published_date
    from v_quarantine""")
def sink_quarantine_jsonl(c: Context) -> DataFrame:
    path = files.write_quarantine(c.refresh.rejects(), c.scratch("quarantine"), files.new_run_id())
    schema = "`table` string, reason string, row struct<knowledge_id:string, summary:string, published_date:string>"
    return c.spark.read.schema(schema).json(path).select("table", "reason", "row.*")


@query("sink_run_id", """
    select "table", count(*) n, true well_formed from v_quarantine group by 1""")
def sink_run_id(c: Context) -> DataFrame:
    run = F.lit(files.new_run_id())
    tagged = c.refresh.rejects().withColumn("run_id", run)
    return tagged.groupBy("table").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(F.col("run_id").rlike(r"^\d{8}T\d{6}Z$")).alias("well_formed"),
    )


# ---- projections, filters, lookups -------------------------------------------------------------

@query("project_dim_knowledge", """
    select knowledge_id, topic_id, source_id, title, summary, review_status, content_status,
      cast(published_date as varchar) published_date, cast(last_reviewed_date as varchar) last_reviewed_date,
      content_version, ai_eligible from v_catalog""")
def project_dim_knowledge(c: Context) -> DataFrame:
    return dates_as_text(curate.dim_knowledge(c.refresh.checked_knowledge))


@query("project_catalog", _CATALOG)
def project_catalog(c: Context) -> DataFrame:
    return dates_as_text(c.refresh.catalog)


@query("filter_approved", _CATALOG + " where review_status = 'APPROVED'")
def filter_approved(c: Context) -> DataFrame:
    return dates_as_text(curate.approved(c.refresh.catalog))


@query("filter_eligible_project", "select * from v_eligible")
def filter_eligible_project(c: Context) -> DataFrame:
    return c.refresh.eligible


@query("filter_ineligible", """
    select knowledge_id, topic_id, topic_name, title, review_status, content_status
    from v_catalog where not ai_eligible order by topic_id, knowledge_id""")
def filter_ineligible(c: Context) -> DataFrame:
    return reports.ineligible(c.refresh.catalog)


@query("lookup_knowledge", _CATALOG + " where knowledge_id in (select knowledge_id from b_reviews)")
def lookup_knowledge(c: Context) -> DataFrame:
    return dates_as_text(reports.lookup_many(c.refresh.catalog, c.raw("b_reviews"), "knowledge_id"))


@query("lookup_source", """
    select source_id, source_name, source_type, url, source_status from v_sources
    where source_id in (select source_id from b_knowledge)""")
def lookup_source(c: Context) -> DataFrame:
    return reports.lookup_many(c.refresh.sources, c.raw("b_knowledge"), "source_id")


@query("check_eligibility", """
    select i.knowledge_id, k.ai_eligible from (select distinct knowledge_id from b_reviews) i
    left join v_catalog k on i.knowledge_id = k.knowledge_id""")
def check_eligibility(c: Context) -> DataFrame:
    return reports.eligibility(c.raw("b_reviews"), c.refresh.catalog)


_TOPICS = "select topic_id, topic_name, parent_category, description from v_topics order by topic_name, topic_id"
_BY_TOPIC = """
    select knowledge_id, title, summary, review_status, content_status, ai_eligible
    from v_catalog where topic_id = '42' order by title, knowledge_id"""


@query("list_topics", _TOPICS)
@query("report_topics", _TOPICS)
def list_topics(c: Context) -> DataFrame:
    return reports.topics(c.refresh.topics)


@query("knowledge_by_topic", _BY_TOPIC)
@query("report_topic_knowledge", _BY_TOPIC)
def knowledge_by_topic(c: Context) -> DataFrame:
    return reports.knowledge_by_topic(c.refresh.catalog, "42")


@query("sort_report_rows", "select * from v_summary order by topic_name, topic_id")
def sort_report_rows(c: Context) -> DataFrame:
    return reports.quality(c.refresh.catalog, c.refresh.summary)["by_topic"]


# ---- quality rules -----------------------------------------------------------------------------

@query("dq_required_fields", """
    select knowledge_id, miss from (select knowledge_id, """ + _missing(S.KNOWLEDGE_REQUIRED) + """ miss
    from b_knowledge) where miss <> ''""")
def dq_required_fields(c: Context) -> DataFrame:
    failing, message = quality.missing_fields(S.KNOWLEDGE_REQUIRED)
    miss = F.regexp_extract(message, r"\[(.*)\]", 1)
    return c.raw("b_knowledge").where(failing).select("knowledge_id", miss.alias("miss"))


@query("dq_parse_date", """
    select knowledge_id, cast(try_cast(published_date as date) as varchar) published from b_knowledge""")
def dq_parse_date(c: Context) -> DataFrame:
    return c.raw("b_knowledge").select("knowledge_id", iso_date(F.col("published_date")).cast("string").alias("published"))


@query("dq_parse_timestamp", """
    select event_id, case when event_id%7=0 then null else ts end ts from events""")
def dq_parse_timestamp(c: Context) -> DataFrame:
    text = F.when(F.col("event_id") % 7 == 0, F.date_format("ts", "yyyy/MM/dd HH:mm")).otherwise(F.col("ts").cast("string"))
    return c.table("events").select("event_id", iso_timestamp(text).cast("timestamp_ntz").alias("ts"))


@query("dq_topic", "select topic_id, description, reason from c_topics")
def dq_topic(c: Context) -> DataFrame:
    return curate.check_topics(c.raw("b_topics")).select("topic_id", "description", "reason")


@query("dq_source", "select source_id, reason from c_sources")
def dq_source(c: Context) -> DataFrame:
    return curate.check_sources(c.raw("b_sources")).select("source_id", "reason")


@query("dq_knowledge", "select knowledge_id, content_version, reason from c_knowledge")
def dq_knowledge(c: Context) -> DataFrame:
    checked = curate.check_knowledge(c.raw("b_knowledge"), c.refresh.topics, c.refresh.sources)
    return checked.select("knowledge_id", "content_version", "reason")


@query("dq_review", "select review_id, reason from c_reviews")
def dq_review(c: Context) -> DataFrame:
    return curate.check_reviews(c.raw("b_reviews"), c.refresh.catalog).select("review_id", "reason")


def _raw(c: Context) -> list[DataFrame]:
    return [c.raw(v) for v in ("b_topics", "b_sources", "b_knowledge", "b_reviews")]


@query("dq_seed_gate", "select * from g_errors")
def dq_seed_gate(c: Context) -> DataFrame:
    return seed_gate.all_errors(*_raw(c))


@query("dq_seed_uniqueness", "select * from g_repeats")
def dq_seed_uniqueness(c: Context) -> DataFrame:
    return seed_gate.uniqueness_errors(*_raw(c))


SQL_VIEWS["g_preview"] = """
    select count(*) n, count(*) filter (review_status='APPROVED' and content_status='CURRENT'
      and s.source_status='ACTIVE') e from b_knowledge k left join b_sources s on k.source_id=s.source_id"""


@query("dq_seed_warnings", """
    select 'knowledge has '||n||' records, expected 30-50' warning from g_preview where n not between 30 and 50
    union all select 'ai_eligible preview: '||e||'/'||n||' records' from g_preview""")
def dq_seed_warnings(c: Context) -> DataFrame:
    return seed_gate.warnings(c.raw("b_knowledge"), c.raw("b_sources"))


@query("dq_gate_abort", """select count(*) > 0 rejected, count(*) errors from g_errors""")
def dq_gate_abort(c: Context) -> DataFrame:
    report = c.scratch("gate_errors")
    errors = seed_gate.all_errors(*_raw(c))
    try:
        seed_gate.abort_on_errors(errors, report)
        rejected = False
    except seed_gate.DeliveryRejected:
        rejected = True
    return c.spark.read.schema(errors.schema).json(report).agg(F.lit(rejected).alias("rejected"), F.count(F.lit(1)).alias("errors"))


# ---- foreign keys, enrichment ------------------------------------------------------------------

@query("join_fk_topic", "select knowledge_id, content_version, topic_id from b_knowledge where topic_id not in (select topic_id from v_topics)")
def join_fk_topic(c: Context) -> DataFrame:
    knowledge = c.raw("b_knowledge").select("knowledge_id", "content_version", "topic_id")
    found = c.refresh.topics.select("topic_id", F.lit(True).alias("found"))
    return sized_join(knowledge, found, "topic_id", "left", ["knowledge_id"]).where("found is null").drop("found")


@query("join_fk_source", "select knowledge_id, content_version, source_id from b_knowledge where source_id in (select source_id from v_sources)")
def join_fk_source(c: Context) -> DataFrame:
    knowledge = c.raw("b_knowledge").select("knowledge_id", "content_version", "source_id")
    return keep_matching(knowledge, c.refresh.sources, "source_id")


@query("join_fk_knowledge", "select review_id, knowledge_id from b_reviews where knowledge_id in (select knowledge_id from v_catalog)")
def join_fk_knowledge(c: Context) -> DataFrame:
    return keep_matching(c.raw("b_reviews").select("review_id", "knowledge_id"), c.refresh.catalog, "knowledge_id")


@query("join_enrich", "select knowledge_id, topic_name, source_name, content_version, ai_eligible from v_catalog")
def join_enrich(c: Context) -> DataFrame:
    fresh = Refresh(*_raw(c), stage=lambda df, name: df)  # one plan from raw rows to the catalog
    return fresh.catalog.select("knowledge_id", "topic_name", "source_name", "content_version", "ai_eligible")


@query("governance_flag", """
    select review_status, content_status, source_status, count(*) n,
      bool_and(review_status='APPROVED' and source_status='ACTIVE' and content_status='CURRENT') ai_eligible
    from b_knowledge k join b_sources s on k.source_id=s.source_id group by 1,2,3""")
def governance_flag(c: Context) -> DataFrame:
    joined = sized_join(c.raw("b_knowledge").select("knowledge_id", "source_id", "review_status", "content_status"),
                        c.raw("b_sources").select("source_id", "source_status"), "source_id", "inner", ["knowledge_id"])
    flag = ai_eligible(F.col("review_status"), F.col("source_status"), F.col("content_status"))
    return joined.groupBy("review_status", "content_status", "source_status").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(flag).alias("ai_eligible")
    )


_REL3 = """
    select for_topic_id, rank, topic_id, topic_name, parent_category from (
      select *, row_number() over (partition by for_topic_id order by topic_name, topic_id) rank from (
        select a.topic_id for_topic_id, b.topic_id, b.topic_name, b.parent_category,
          b.parent_category = p.parent_category same, max(coalesce(b.parent_category = p.parent_category, false))
            over (partition by a.topic_id) any_same
        from r_asked a left join v_topics p on a.topic_id = p.topic_id join v_topics b on b.topic_id <> a.topic_id)
      where coalesce(same, false) = any_same) where rank <= 3"""
SQL_VIEWS["r_asked"] = "select distinct topic_id from b_knowledge"


@query("topk_related_topics", _REL3)
def topk_related_topics(c: Context) -> DataFrame:
    return reports.related_topics(c.refresh.topics, c.raw("b_knowledge"), limit=3)


@query("join_related_category", """
    select t.topic_id for_topic_id, count(*) - 1 siblings, t.parent_category
    from v_topics t join v_topics o on t.parent_category = o.parent_category group by 1, 3""")
def join_related_category(c: Context) -> DataFrame:
    """How many siblings each topic has: counted per category, never paired."""
    dim = c.refresh.topics
    sizes = dim.groupBy("parent_category").agg((F.count(F.lit(1)) - 1).alias("siblings"))
    own = dim.select(F.col("topic_id").alias("for_topic_id"), "parent_category")
    return sized_join(own, sizes, "parent_category", "inner", ["for_topic_id"])


@query("join_scalar_subquery", """
    select topic_id, topic_name, parent_category from v_topics where topic_id <> '42' and parent_category =
      (select parent_category from v_topics where topic_id = '42') order by topic_name, topic_id""")
def join_scalar_subquery(c: Context) -> DataFrame:
    sql = """
        select topic_id, topic_name, parent_category from {dim} where topic_id <> :id and parent_category =
          (select parent_category from {dim} where topic_id = :id) order by topic_name, topic_id"""
    return files.param_query(c.spark, sql, {"id": "42"}, dim=c.refresh.topics)


# ---- aggregates and reports --------------------------------------------------------------------

@query("agg_dedup_quarantine_all", """select knowledge_id, reason from c_knowledge where starts_with(reason, 'duplicate')""")
def agg_dedup_quarantine_all(c: Context) -> DataFrame:
    marked = quality.annotate_duplicates(c.raw("b_knowledge"), "knowledge_id")
    return marked.where("duplicate_reason is not null").select("knowledge_id", F.col("duplicate_reason").alias("reason"))


@query("agg_topic_summary", "select * from v_summary")
def agg_topic_summary(c: Context) -> DataFrame:
    return curate.topic_summary(c.refresh.catalog)


_TOTALS = """
    select cast(coalesce(sum(total_count), 0) as bigint) total_knowledge_count,
      cast(coalesce(sum(eligible_count), 0) as bigint) eligible_count,
      case when sum(total_count) > 0 then round_even(100.0 * sum(eligible_count) / sum(total_count), 1) else 0.0 end
        eligible_percentage from v_summary"""


@query("agg_quality_totals", _TOTALS)
def agg_quality_totals(c: Context) -> DataFrame:
    return reports.quality_totals(c.refresh.summary).select(
        "total_knowledge_count", "eligible_count", six("eligible_percentage")
    )


@query("report_quality", """
    select 'total' section, null topic_id, total_knowledge_count n, eligible_count m from (""" + _TOTALS + """)
    union all select 'topic', topic_id, total_count, eligible_count from v_summary
    union all select 'ineligible', topic_id, count(*), 0 from v_catalog where not ai_eligible group by topic_id""")
def report_quality(c: Context) -> DataFrame:
    parts = reports.quality(c.refresh.catalog, c.refresh.summary)
    total = parts["totals"].select(F.lit("total").alias("section"), F.lit(None).cast("string").alias("topic_id"),
                                   F.col("total_knowledge_count").alias("n"), F.col("eligible_count").alias("m"))
    topic = parts["by_topic"].select(F.lit("topic"), "topic_id", "total_count", "eligible_count")
    rest = parts["ineligible"].groupBy("topic_id").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("ineligible"), "topic_id", "n", F.lit(0).cast("long"))
    return total.union(topic).union(rest)


@query("union_quarantine", """select "table", reason, "row" from v_quarantine""")
def union_quarantine(c: Context) -> DataFrame:
    return c.refresh.rejects()


@query("report_dq_dimensions", """
    select "table", case when starts_with(reason, 'missing required fields') then 'completeness'
      when starts_with(reason, 'duplicate id') then 'uniqueness' else 'validity' end dimension, count(*) rejected
    from v_quarantine group by 1, 2""")
def report_dq_dimensions(c: Context) -> DataFrame:
    return reports.quality_dimensions(c.refresh.rejects())


@query("report_freshness", """
    select 'events' "table", max(ts) newest, date_sub('second', max(ts), timestamp '2025-01-01') age_seconds from events
    union all select 'catalog', cast(max(last_reviewed_date) as timestamp),
      date_sub('second', cast(max(last_reviewed_date) as timestamp), timestamp '2025-01-01') from v_catalog""")
def report_freshness(c: Context) -> DataFrame:
    tables = {"events": (c.table("events"), "ts"), "catalog": (c.refresh.catalog, "last_reviewed_date")}
    out = reports.freshness(tables, F.lit("2025-01-01 00:00:00").cast("timestamp"))
    return out.withColumn("newest", F.col("newest").cast("timestamp_ntz"))
