"""Events (batch and stream), usage metrics and agent traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep import schemas as S
from lorekeep.operators import analytics, traces
from lorekeep.operators.quality import annotate, client_event_rules
from lorekeep.session import staged
from lorekeep.sources import files, streams
from lorekeep.streaming import compaction, events
from lorekeep.testbed import bindings
from lorekeep.testbed.registry import SQL_VIEWS, Context, query, six

UNREADABLE = "unparseable JSON: not one JSON value in UTF-8"

SQL_VIEWS.update({
    "c_events": """
        select *, case when event_id = '' or session_id = '' then 'missing required fields: ['||
            concat_ws(', ', case when event_id = '' then '''event_id''' end,
              case when event_type is null then '''event_type''' end,
              case when session_id = '' then '''session_id''' end)||']'
          when event_type not in ('QUESTION_ASKED','RESPONSE_GENERATED','SOURCE_OPENED','RELATED_TOPIC_OPENED',
            'FEEDBACK_SUBMITTED') then 'invalid event_type '''||event_type||''''
          when rating not in ('up','down') then 'invalid rating '''||rating||'''' end reason
        from b_events""",
    "v_fact": """
        select event_id, event_type, session_id, trace_id, topic_id, knowledge_id, rating,
          cast(latency_ms as double) latency_ms, cast(source_count as bigint) source_count, occurred_at
        from c_events where reason is null""",
    # The same events as messages, some of them damaged; see _payloads.
    "m_events": f"""
        select *, case when m in (10, 30, 50) then '{UNREADABLE}' when m = 20 then 'event is not a JSON object'
          when base_reason is not null then base_reason when m = 60 then 'invalid latency_ms ''fast''' end reason
        from (select * exclude (reason), reason base_reason, cast(event_id as bigint) % 100 m from c_events)""",
    "m_fact": """
        select event_id, event_type, session_id, trace_id, topic_id, knowledge_id, rating,
          cast(latency_ms as double) latency_ms, cast(source_count as bigint) source_count, occurred_at
        from m_events where reason is null""",
    "v_global": """
        select count(*) filter (event_type='QUESTION_ASKED') total_questions_asked,
          count(*) filter (event_type='RESPONSE_GENERATED') total_responses_generated,
          avg(latency_ms) filter (event_type='RESPONSE_GENERATED') avg_response_latency_ms,
          count(*) filter (event_type='SOURCE_OPENED') total_source_opens,
          count(*) filter (event_type='RELATED_TOPIC_OPENED') total_related_topic_opens,
          count(*) filter (event_type='FEEDBACK_SUBMITTED' and rating='up') feedback_up_count,
          count(*) filter (event_type='FEEDBACK_SUBMITTED' and rating='down') feedback_down_count
        from v_fact""",
    "v_by_topic": """
        select topic_id, count(*) filter (event_type='SOURCE_OPENED') source_open_count,
          count(*) filter (event_type='RELATED_TOPIC_OPENED') related_topic_open_count
        from v_fact where topic_id is not null group by topic_id""",
    "v_trace_rows": """
        select 'trace_'||cast(case when event_id%10=9 then event_id-1 else event_id end as string) trace_id,
          ts recorded_at, value total_latency_ms,
          case when event_id%3=0 then 'know_6' else 'know_'||cast(event_id*7%1100 as string) end a1,
          'know_'||cast(user_id*13%1100 as string) a2,
          case when event_id%4=0 then '' else 'know_nowhere' end a3,
          case when event_id%5=0 then 'list_topics' else 'search_knowledge' end tool2,
          'know_'||cast(event_id*3%1100 as string) b1, 'know_'||cast(event_id*7%1100 as string) b2
        from events""",
    "v_traces": """
        select * from (select *, row_number() over (partition by trace_id order by recorded_at desc) rn
          from v_trace_rows) where rn = 1""",
    "v_ids": """
        select trace_id, id, row_number() over (partition by trace_id order by first) - 1 pos from (
          select trace_id, id, min(p) first from (
            select trace_id, 1 p, a1 id from v_traces union all select trace_id, 2, a2 from v_traces
            union all select trace_id, 3, a3 from v_traces
            union all select trace_id, 4, b1 from v_traces where tool2 = 'search_knowledge'
            union all select trace_id, 5, b2 from v_traces where tool2 = 'search_knowledge')
          where id <> '' group by trace_id, id)""",
    "v_cards": """
        select i.trace_id, i.pos, k.knowledge_id, k.title, k.source_name, coalesce(s.url, '') source_url,
          cast(k.last_reviewed_date as varchar) last_reviewed_date, k.topic_id
        from v_ids i join v_catalog k on i.id = k.knowledge_id
        left join v_sources s on k.source_id = s.source_id where i.pos < 3""",
    "v_rel2": """
        select for_topic_id, list(topic_id order by rank) rel from (
          select *, row_number() over (partition by for_topic_id order by topic_name, topic_id) rank from (
            select a.topic_id for_topic_id, b.topic_id, b.topic_name, b.parent_category = p.parent_category same,
              max(b.parent_category = p.parent_category) over (partition by a.topic_id) any_same
            from (select distinct topic_id from v_cards) a join v_topics p on a.topic_id = p.topic_id
            join v_topics b on b.topic_id <> a.topic_id)
          where same = any_same) where rank <= 2 group by for_topic_id""",
    "v_steps": """
        select trace_id, max(topic_id) filter (ord=1) t1, max(topic_id) filter (ord=2) t2,
          max(topic_id) filter (ord=3) t3, any_value(rel) filter (ord=1) r1, any_value(rel) filter (ord=2) r2,
          any_value(rel) filter (ord=3) r3
        from (select c.trace_id, c.topic_id, r.rel, row_number() over (partition by c.trace_id order by c.pos) ord
          from v_cards c join v_rel2 r on c.topic_id = r.for_topic_id) group by trace_id""",
    "v_fold": """
        select trace_id, list_concat(r1, n2, case when t3 is null or list_contains(seen2, t3) then []
            else list_filter(r3, lambda x: not list_contains(list_append(seen2, t3), x)) end) rel
        from (select *, case when t2 is null or list_contains(seen1, t2) then seen1
              else list_concat(list_append(seen1, t2), n2) end seen2
          from (select *, case when t2 is null or list_contains(seen1, t2) then []
                else list_filter(r2, lambda x: not list_contains(list_append(seen1, t2), x)) end n2
            from (select *, list_concat([t1], r1) seen1 from v_steps)))""",
    "v_related": """
        select f.trace_id, f.pos, f.topic_id, t.topic_name
        from (select trace_id, unnest(rel) topic_id, unnest(range(len(rel))) pos from v_fold) f
        join v_topics t on f.topic_id = t.topic_id""",
    "v_results": """
        select event_id, case
          when event_type='view' then '{"results":[{"knowledge_id":"know_'||cast(event_id as string)||'"},7,{"other":1}]}'
          when event_type='click' then '{"topics":['||cast(event_id as string)||',2,3]}'
          when event_type='purchase' then '{"related_topics":["a"],"error":"x"}'
          when event_type='signup' then '{"error":"failed '||cast(event_id as string)||'","z":1}'
          when event_id%2=0 then props else '"plain '||cast(event_id as string)||'"' end result,
          event_type, event_id%2=0 even
        from events""",
})


# ---- events as a batch -------------------------------------------------------------------------

@query("dq_event", "select event_id, reason from c_events")
def dq_event(c: Context) -> DataFrame:
    return c.checked_events.select("event_id", "reason")


@query("filter_client_events", """
    select event_id, event_type, case
      when event_type not in ('SOURCE_OPENED','RELATED_TOPIC_OPENED','FEEDBACK_SUBMITTED')
        then 'event_type not accepted from clients '''||event_type||''''
      when rating not in ('up','down') then 'invalid rating '''||rating||'''' end reason
    from b_events""")
def filter_client_events(c: Context) -> DataFrame:
    return annotate(c.raw("b_events"), client_event_rules()).select("event_id", "event_type", "reason")


def _payloads(event_rows: DataFrame) -> DataFrame:
    """Events as message bytes with a stray field; every tenth of a hundred is damaged its own way."""
    columns = [c for c in event_rows.columns if c not in ("latency_ms", "occurred_at")]
    m = F.col("event_id").cast("long") % 100
    latency = F.when(m == 60, F.lit("fast")).otherwise(F.col("latency_ms").cast("string")).alias("latency_ms")
    body = F.to_json(
        F.struct(*columns, latency, F.col("occurred_at").cast("string").alias("occurred_at"),
                 F.lit("what is said here must not be kept").alias("question_text")),
        {"ignoreNullFields": "false"},
    )
    text = (
        F.when(m == 10, F.concat(F.lit("not json "), F.col("event_id")))
        .when(m == 20, F.lit("[1, 2]"))
        .when(m == 30, F.concat(body, F.lit(" tail")))
        .when(m == 40, F.regexp_replace(body, r"^\{", '{"rating":"first value",'))
        .otherwise(body)
    ).cast("binary")
    return event_rows.select(F.when(m == 50, F.concat(F.unhex(F.lit("FF")), text)).otherwise(text).alias("value"))


@query("project_event_allowlist", "select * from m_fact")
def project_event_allowlist(c: Context) -> DataFrame:
    out = events.normalize_events(events.annotate_events(_payloads(c.raw("b_events"))))
    return out.withColumn("occurred_at", F.col("occurred_at").cast("timestamp_ntz"))


@query("event_envelope", """
    select event_type, session_id, trace_id, topic_id, knowledge_id, rating, true well_formed, true alone, true recent,
      true nothing_else
    from b_events where event_type in ('SOURCE_OPENED','RELATED_TOPIC_OPENED','FEEDBACK_SUBMITTED')
      and coalesce(rating, 'up') in ('up','down') and session_id <> ''""")
def event_envelope(c: Context) -> DataFrame:
    """Accepted client submissions, enveloped, sent and read back as valid events.  Ids and times are made
    afresh, so what is told of them is their form, that each id occurs once, and that the times are today's."""
    accepted = annotate(c.raw("b_events"), client_event_rules()).where("reason is null and session_id <> ''")
    sent = staged(events.envelope(accepted.select("event_type", "session_id", "trace_id", "topic_id", "knowledge_id", "rating")), "sent")
    read = staged(events.normalize_events(events.annotate_events(events.to_messages(sent))), "read")
    repeated = read.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    now, at = F.current_timestamp(), F.col("occurred_at").cast("timestamp")
    return read.join(repeated, "event_id").select(
        "event_type", "session_id", "trace_id", "topic_id", "knowledge_id", "rating",
        F.col("event_id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$").alias("well_formed"), (F.col("n") == 1).alias("alone"),
        at.between(now - F.expr("interval 1 day"), now + F.expr("interval 1 day")).alias("recent"),
        (F.col("latency_ms").isNull() & F.col("source_count").isNull()).alias("nothing_else"))


# ---- events as a stream ------------------------------------------------------------------------

def _stream(c: Context) -> DataFrame:
    """The event table as a stream of messages (a file stream stands in for the queue)."""
    schema = c.table("events").schema
    rows = c.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(c.sf_dir)
    rows = rows.repartition(c.spark.sparkContext.defaultParallelism)  # one file, but many parsers
    return _payloads(bindings.run_sql(c.spark, bindings.VIEWS["b_events"], {"events": rows}))


def _drain(c: Context) -> tuple[str, str]:
    """Runs the event stream over everything that has arrived; (fact folder, quarantine folder)."""
    base = c.scratch("events_stream")
    started = events.start(_stream(c), f"{base}/fact", f"{base}/quarantine", f"{base}/checkpoint", available_now=True)
    started.awaitTermination()
    return f"{base}/fact", f"{base}/quarantine"


def _folded(c: Context) -> compaction.EventLog:
    """The event stream in several batches, all but the last folded into days."""
    base = c.scratch("events_lake")
    messages = _payloads(bindings.run_sql(c.spark, bindings.VIEWS["b_events"], {"events": c.table("events")}))
    cores = max(2, c.spark.sparkContext.defaultParallelism)  # three batches, each of as many files as there are parsers
    messages.repartition(3 * cores).write.parquet(f"{base}/in")
    arriving = c.spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", cores).parquet(f"{base}/in")
    events.start(arriving, f"{base}/{compaction.FACT}", f"{base}/{compaction.QUARANTINE}", f"{base}/checkpoint", True,
                 f"{base}/{compaction.METRICS}").awaitTermination()
    compaction.compact(files.snapshot(c.spark, base))
    return compaction.EventLog(files.snapshot(c.spark, base))


@query("stream_compacted_events", "select * from m_fact")
def stream_compacted_events(c: Context) -> DataFrame:
    rows = _folded(c).events().select(*S.EVENT_COLUMNS)
    return rows.withColumn("occurred_at", F.col("occurred_at").cast("timestamp_ntz"))


def _fact(c: Context, path: str) -> DataFrame:
    rows = c.spark.read.parquet(path).select(*S.EVENT_COLUMNS)
    return rows.withColumn("occurred_at", F.col("occurred_at").cast("timestamp_ntz"))


@query("scan_stream_events", "select conv_id, turn, role from conversations")
def scan_stream_events(c: Context) -> DataFrame:
    base = c.scratch("lines")
    lines = c.table("conversations").select(F.to_json(F.struct("conv_id", "turn", "role")).alias("value"))
    lines.write.text(f"{base}/in")
    arriving = streams.text_messages(c.spark, f"{base}/in")
    body = F.from_json(F.col("value").cast("string"), "conv_id long, turn long, role string")
    (
        arriving.select(body.alias("m")).select("m.*").writeStream.format("parquet")
        .option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).start().awaitTermination()
    )
    return c.spark.read.schema("conv_id long, turn long, role string").parquet(f"{base}/out")


@query("stream_parse_validate", """
    select case when m in (10, 20, 30, 50) then null else event_id end event_id, reason from m_events""")
def stream_parse_validate(c: Context) -> DataFrame:
    base = c.scratch("annotated")
    (
        events.annotate_events(_stream(c)).select("event_id", "reason").writeStream.format("parquet")
        .option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).start().awaitTermination()
    )
    return c.spark.read.schema("event_id string, reason string").parquet(f"{base}/out")


@query("sink_stream_append", "select * from m_fact")
def sink_stream_append(c: Context) -> DataFrame:
    return _fact(c, _drain(c)[0])


@query("sink_stream_quarantine", """
    select reason, case m when 10 then 'not json '||event_id when 20 then '[1, 2]' end raw_payload, count(*) n
    from m_events where reason is not null group by all""")
def sink_stream_quarantine(c: Context) -> DataFrame:
    rows = c.spark.read.schema(S.QUARANTINED_EVENT).parquet(_drain(c)[1])
    short = F.when(F.col("raw_payload").rlike(r"^(not json \d+|\[1, 2\])$"), F.col("raw_payload"))
    return rows.groupBy("reason", short.alias("raw_payload")).agg(F.count(F.lit(1)).alias("n"))


@query("stream_split", """
    select 'fact' side, count(*) n from m_events where reason is null
    union all select 'quarantine', count(*) from m_events where reason is not null""")
def stream_split(c: Context) -> DataFrame:
    fact, quarantine = _drain(c)
    def count(path: str, side: str) -> DataFrame:
        return c.spark.read.parquet(path).agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"))

    return count(fact, "fact").unionByName(count(quarantine, "quarantine"))


@query("stream_stamp", "select reason, true stamped, count(*) n from m_events where reason is not null group by 1")
def stream_stamp(c: Context) -> DataFrame:
    rows = c.spark.read.schema(S.QUARANTINED_EVENT).parquet(_drain(c)[1])
    stamped = F.bool_and(F.col("quarantined_at").isNotNull() & (F.col("quarantined_at") <= F.current_timestamp()))
    return rows.groupBy("reason").agg(stamped.alias("stamped"), F.count(F.lit(1)).alias("n"))


@query("stream_bounded_run", "select event_id, occurred_at from m_fact")
def stream_bounded_run(c: Context) -> DataFrame:
    """An unbounded query, stopped after a while; what had arrived by then is in the fact."""
    base = c.scratch("bounded")
    started = events.start(_stream(c), f"{base}/fact", f"{base}/quarantine", f"{base}/checkpoint")
    started.processAllAvailable()
    events.run_for(started, 0.2)
    return _fact(c, f"{base}/fact").select("event_id", "occurred_at")


@query("scan_file_stream", "select url object_name, cast(length(html) as bigint) size_bytes from pages")
def scan_file_stream(c: Context) -> DataFrame:
    """File signals from a stream of notifications, one per page."""
    base = c.scratch("notes")
    note = F.struct(F.lit("pages").alias("bucket"), F.col("url").alias("name"),
                    F.length("html").cast("string").alias("size"))
    c.table("pages").select(F.to_json(note).alias("value")).write.text(f"{base}/in")
    signals = files.file_signals(streams.notifications(streams.text_messages(c.spark, f"{base}/in")))
    (
        signals.writeStream.format("parquet").option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    )
    return c.spark.read.schema(signals.schema).parquet(f"{base}/out").select("object_name", "size_bytes")


# ---- metrics -----------------------------------------------------------------------------------

_GLOBAL = """
    select * replace (round(avg_response_latency_ms, 6) as avg_response_latency_ms) from v_global"""
_LONG = "union all ".join(
    [f"select '{m}' metric_name, cast(null as varchar) dimension, round(coalesce(cast({m} as double), 0.0), 6) "
     f"metric_value, timestamp '2024-02-01' computed_at from v_global " for m in analytics.GLOBAL_METRICS]
    + [f"select '{m}', topic_id, cast({m} as double), timestamp '2024-02-01' from v_by_topic " for m in analytics.TOPIC_METRICS]
)


def _long(c: Context, fact: DataFrame) -> DataFrame:
    return analytics.question_analytics(fact, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))


@query("agg_events_global", _GLOBAL)
def agg_events_global(c: Context) -> DataFrame:
    return analytics.events_global(c.fact).withColumn("avg_response_latency_ms", six("avg_response_latency_ms"))


@query("agg_events_by_topic", "select * from v_by_topic")
def agg_events_by_topic(c: Context) -> DataFrame:
    return analytics.events_by_topic(c.fact)


@query("reshape_metrics_long", _LONG)
@query("union_metrics", _LONG)
def reshape_metrics_long(c: Context) -> DataFrame:
    return _long(c, c.fact).withColumn("metric_value", six("metric_value"))


@query("stream_analytics_refresh", _LONG.replace("v_global", "s_global").replace("v_by_topic", "s_by_topic"))
def stream_analytics_refresh(c: Context) -> DataFrame:
    """Metrics added up from the partial ones that batches of the stream have left."""
    parts = analytics.add_up(_folded(c).metrics())
    return analytics.merged_analytics(parts, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).withColumn("metric_value", six("metric_value"))


SQL_VIEWS["s_global"] = SQL_VIEWS["v_global"].replace("v_fact", "m_fact")
SQL_VIEWS["s_by_topic"] = SQL_VIEWS["v_by_topic"].replace("v_fact", "m_fact")

_WIDE = """
    select null topic_id, cast(total_questions_asked as double) total_questions_asked,
      cast(total_responses_generated as double) total_responses_generated,
      round(coalesce(avg_response_latency_ms, 0.0), 6) avg_response_latency_ms,
      cast(total_source_opens as double) total_source_opens,
      cast(total_related_topic_opens as double) total_related_topic_opens,
      cast(feedback_up_count as double) feedback_up_count, cast(feedback_down_count as double) feedback_down_count,
      null source_open_count, null related_topic_open_count from v_global
    union all select topic_id, null, null, null, null, null, null, null, cast(source_open_count as double),
      cast(related_topic_open_count as double) from v_by_topic"""


@query("reshape_metrics_wide", _WIDE)
@query("report_analytics", _WIDE)
def reshape_metrics_wide(c: Context) -> DataFrame:
    overall, topics = analytics.metrics_wide(_long(c, c.fact))
    both = overall.withColumn("topic_id", F.lit(None).cast("string")).unionByName(topics, allowMissingColumns=True)
    return both.drop("computed_at").withColumn("avg_response_latency_ms", six("avg_response_latency_ms"))


@query("agg_log_metrics", """
    select 'requests' metric, service, substr(cast(status as varchar), 1, 1) status_class, count(*) n
    from (select event_type service, 100 + 5 * cast(json_extract(props, '$.k') as bigint) status from events)
    where status > 0 group by all
    union all select 'server_errors', service, null, count(*)
    from (select event_type service, 100 + 5 * cast(json_extract(props, '$.k') as bigint) status from events)
    where status >= 500 group by all""")
def agg_log_metrics(c: Context) -> DataFrame:
    status = 100 + 5 * F.get_json_object("props", "$.k").cast("long")
    return analytics.log_metrics(c.table("events").select(F.col("event_type").alias("service"), status.alias("status")))


# ---- traces ------------------------------------------------------------------------------------

def _traces(c: Context) -> DataFrame:
    """Two tool calls per trace; the second is not always a search."""
    flat = bindings.run_sql(c.spark, SQL_VIEWS["v_trace_rows"], {"events": c.table("events")})

    def call(tool, latency, *ids):
        found = F.array(*ids)
        return F.struct(
            tool.alias("tool"), F.create_map(F.lit("query"), F.lit("q")).alias("args"),
            latency.alias("latency_ms"),
            F.struct(F.size(found).cast("long").alias("candidate_count"),
                     found.alias("candidate_knowledge_ids")).alias("result_summary"),
        )

    calls = F.array(
        call(F.lit(traces.SEARCH_TOOL), F.col("total_latency_ms"), "a1", "a2", "a3"),
        call(F.col("tool2"), F.col("total_latency_ms"), "b1", "b2"),
    )
    return flat.select("trace_id", "recorded_at", "total_latency_ms", calls.alias("tool_calls"))


def _latest_ids(c: Context) -> DataFrame:
    return traces.latest_candidates(_traces(c))


@query("distinct_candidate_ids", "select trace_id, string_agg(id, ',' order by pos) ids from v_ids group by trace_id")
def distinct_candidate_ids(c: Context) -> DataFrame:
    return _latest_ids(c).select("trace_id", F.array_join("ids", ",").alias("ids"))


@query("limit_sources", "select trace_id, string_agg(id, ',' order by pos) ids from v_ids where pos < 3 group by trace_id")
def limit_sources(c: Context) -> DataFrame:
    return _latest_ids(c).select("trace_id", F.array_join(F.slice("ids", 1, traces.MAX_SOURCES), ",").alias("ids"))


@query("join_source_cards", """
    select trace_id, pos, knowledge_id, title, source_name, source_url, last_reviewed_date from v_cards""")
def join_source_cards(c: Context) -> DataFrame:
    return traces.source_cards(_latest_ids(c), c.refresh.catalog, c.refresh.sources)


@query("seen_set_fold", "select * from v_related")
def seen_set_fold(c: Context) -> DataFrame:
    return traces.related_for_answers(_latest_ids(c), c.refresh.catalog, c.refresh.topics)


@query("report_answer_sources", """
    select trace_id, 'source' kind, pos, knowledge_id id, title, source_url detail from v_cards
    union all select trace_id, 'related', pos, topic_id, topic_name, null from v_related""")
def report_answer_sources(c: Context) -> DataFrame:
    ids = _latest_ids(c)
    shown = traces.shown_records(ids, c.refresh.catalog)
    cards = traces.source_cards(ids, c.refresh.catalog, c.refresh.sources, shown=shown)
    related = traces.related_for_answers(ids, c.refresh.catalog, c.refresh.topics, shown=shown)
    return cards.select(
        "trace_id", F.lit("source").alias("kind"), "pos", F.col("knowledge_id").alias("id"), "title",
        F.col("source_url").alias("detail"),
    ).unionByName(related.select(
        "trace_id", F.lit("related").alias("kind"), "pos", F.col("topic_id").alias("id"),
        F.col("topic_name").alias("title"), F.lit(None).cast("string").alias("detail"),
    ))


_RECENT = "select trace_id, recorded_at, total_latency_ms from v_traces order by recorded_at desc, trace_id limit 20"


@query("topk_recent_traces", _RECENT)
@query("report_traces", _RECENT)
def topk_recent_traces(c: Context) -> DataFrame:
    return traces.recent_traces(_traces(c)).select("trace_id", "recorded_at", "total_latency_ms")


@query("trace_by_id", """
    select trace_id, recorded_at, total_latency_ms from v_traces
    where trace_id in (select 'trace_'||cast(item_id as varchar) from benchmark)""")
def trace_by_id(c: Context) -> DataFrame:
    """A batch of wanted ids, each with its latest record."""
    ids = c.table("benchmark").select(F.concat(F.lit("trace_"), F.col("item_id").cast("string")).alias("trace_id"))
    return traces.traces_by_id(_traces(c), ids).select("trace_id", "recorded_at", "total_latency_ms")


@query("trace_summary", """
    select event_id,
      case when event_type='view' then 3 end candidate_count,
      case when event_type='view' then 'know_'||event_id||',-' end candidate_ids,
      case when event_type='click' then 3 end topic_count,
      case when event_type='purchase' then 1 end related_count,
      case when event_type='signup' then 'failed '||event_id end error,
      case when event_type='error' and even then 'k' end "keys",
      case when event_type='error' and not even then 'plain '||event_id end value
    from v_results""")
def trace_summary(c: Context) -> DataFrame:
    rows = bindings.run_sql(c.spark, SQL_VIEWS["v_results"], {"events": c.table("events")})
    return rows.select("event_id", traces.summarize_result(F.col("result")).alias("s")).select(
        "event_id", "s.candidate_count", F.array_join("s.candidate_knowledge_ids", ",", "-").alias("candidate_ids"),
        "s.topic_count", "s.related_count", "s.error", F.array_join("s.keys", ",").alias("keys"), "s.value",
    )
