"""Agent traces: candidate ids, source cards, related topics, recent traces, result summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.joins import keep_matching, sized_join
from lorekeep.operators.reports import related_lists
from lorekeep.session import staged

SEARCH_TOOL = "search_knowledge"
# How many cards an answer shows and related topics each source topic adds.
MAX_SOURCES, RELATED_PER_SOURCE = 3, 2
# Traces kept, and shown by default.
KEPT_TRACES, SHOWN_TRACES = 200, 20
BROADCAST_ROWS = 10_000  # (trace id, time) pairs


def candidate_ids(tool_calls: Column) -> Column:
    """Ids the search calls of one trace surfaced, in call order, each once, blanks dropped."""
    none = F.array().cast("array<string>")
    searches = F.filter(tool_calls, lambda c: c["tool"] == SEARCH_TOOL)
    ids = F.flatten(F.transform(searches, lambda c: F.coalesce(c["result_summary"]["candidate_knowledge_ids"], none)))
    return F.coalesce(F.array_distinct(F.filter(ids, lambda i: i.isNotNull() & (i != ""))), none)


def with_candidates(traces: DataFrame) -> DataFrame:
    return traces.select("trace_id", candidate_ids(F.col("tool_calls")).alias("ids"))


def latest_candidates(traces: DataFrame) -> DataFrame:
    """``(trace_id, ids)`` of each trace's latest record; reduced to ids before anything shuffles,
    and staged, as cards and related topics both start from it."""
    narrow = traces.select("trace_id", "recorded_at", candidate_ids(F.col("tool_calls")).alias("ids"))
    return staged(latest_traces(narrow).select("trace_id", "ids"), "candidate_ids")


def _shown(ids: DataFrame, catalog: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` candidates of each trace that exist; the cut comes before unknown ids
    are dropped.  ``pos`` keeps their order."""
    first = ids.select("trace_id", F.posexplode(F.slice("ids", 1, limit)).alias("pos", "knowledge_id"))
    return sized_join(first, catalog, "knowledge_id", "inner", ["trace_id"])


def shown_records(ids: DataFrame, catalog: DataFrame, limit: int = MAX_SOURCES) -> DataFrame:
    """The records behind the cards of each trace, staged: cards and related topics both start from them, so
    the catalog is joined once for a whole answer."""
    records = catalog.select("knowledge_id", "topic_id", "source_id", "title", "source_name", "last_reviewed_date")
    return staged(_shown(ids, records, limit), "shown")


def source_cards(
    ids: DataFrame, catalog: DataFrame, sources: DataFrame, limit: int = MAX_SOURCES, shown: DataFrame | None = None,
) -> DataFrame:
    """One row per card: ``(trace_id, pos, knowledge_id, title, source_name, source_url,
    last_reviewed_date)``; a source that is gone gives an empty url.  ``shown`` may give ``shown_records``."""
    records = catalog.select("knowledge_id", "source_id", "title", "source_name", "last_reviewed_date")
    urls = sources.select("source_id", "url")
    if shown is None:  # records meet their sources once, not once per card
        cards = _shown(ids, sized_join(records, urls, "source_id", "left", ["knowledge_id"]), limit)
    else:
        cards = sized_join(shown, urls, "source_id", "left", ["trace_id", "pos"])
    return cards.select(
        "trace_id", F.col("pos").cast("long").alias("pos"), "knowledge_id", "title",
        F.coalesce("source_name", F.lit("")).alias("source_name"),
        F.coalesce("url", F.lit("")).alias("source_url"),
        F.col("last_reviewed_date").cast("string").alias("last_reviewed_date"),
    )


def _fold(steps: Column) -> Column:
    """Walk the source topics in order: one already seen adds nothing, else it and its unseen
    related topics become seen and those are added."""
    start = F.struct(
        F.array().cast("array<string>").alias("seen"),
        F.array().cast("array<struct<topic_id:string,topic_name:string>>").alias("related"),
    )

    def step(acc: Column, item: Column) -> Column:
        seen = F.array_append(acc["seen"], item["topic_id"])
        fresh = F.filter(item["related"], lambda r: ~F.array_contains(seen, r["topic_id"]))
        grown = F.struct(
            F.concat(seen, F.transform(fresh, lambda r: r["topic_id"])).alias("seen"),
            F.concat(acc["related"], fresh).alias("related"),
        )
        return F.when(F.array_contains(acc["seen"], item["topic_id"]), acc).otherwise(grown)

    return F.aggregate(steps, start, step, lambda acc: acc["related"])


def related_for_answers(
    ids: DataFrame, catalog: DataFrame, dim: DataFrame,
    per_topic: int = RELATED_PER_SOURCE, limit: int = MAX_SOURCES, shown: DataFrame | None = None,
) -> DataFrame:
    """One row per suggestion: ``(trace_id, pos, topic_id, topic_name)``.  ``shown`` may give ``shown_records``."""
    if shown is None:
        shown = staged(_shown(ids, catalog.select("knowledge_id", "topic_id"), limit), "shown")
    shown = shown.select("trace_id", "pos", "topic_id")
    # Only the topics shown need a list, and staging the lists tells whether they can be broadcast.
    lists = staged(related_lists(dim, shown, per_topic).select(
        F.col("for_topic_id").alias("topic_id"),
        F.transform("related", lambda t: F.struct(
            t["topic_id"].alias("topic_id"), t["topic_name"].alias("topic_name"))).alias("related"),
    ), "related_lists")
    steps = sized_join(shown, lists, "topic_id", "inner", ["trace_id", "pos"])
    # At most ``limit`` steps per trace, so the collected arrays are bounded.
    per_trace = steps.groupBy("trace_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "topic_id", "related"))).alias("steps")
    )
    return per_trace.select("trace_id", F.posexplode(_fold(F.col("steps"))).alias("pos", "t")).select(
        "trace_id", F.col("pos").cast("long").alias("pos"), "t.topic_id", "t.topic_name"
    )


def latest_traces(traces: DataFrame) -> DataFrame:
    """A trace recorded again replaces its older record; of records of one time the last by text
    stays.  ``max_by`` combines on the map side, so an id recorded endlessly never gathers in one task."""
    rest = [c for c in traces.columns if c != "trace_id"]
    newest = F.max_by(F.struct(*rest), F.struct("recorded_at", F.to_json(F.struct(*rest)))).alias("t")
    return traces.groupBy("trace_id").agg(newest).select("trace_id", "t.*")


def recent_traces(traces: DataFrame, limit: int = SHOWN_TRACES, keep: int = KEPT_TRACES) -> DataFrame:
    """Latest first; never more than the ``keep`` newest.

    Times alone decide which traces are shown; only those few rows are then fetched in full.
    """
    shown = min(limit, keep)
    newest = (
        traces.groupBy("trace_id").agg(F.max("recorded_at").alias("recorded_at"))
        .orderBy(F.desc("recorded_at"), F.asc("trace_id")).limit(shown)
    )
    few = F.broadcast(newest) if shown <= BROADCAST_ROWS else newest
    rows = traces.join(few, ["trace_id", "recorded_at"])
    return latest_traces(rows).orderBy(F.desc("recorded_at"), F.asc("trace_id")).limit(shown)


def trace_by_id(traces: DataFrame, trace_id: str) -> DataFrame:
    return latest_traces(traces.where(F.col("trace_id") == trace_id))


def traces_by_id(traces: DataFrame, ids: DataFrame) -> DataFrame:
    """The latest record of every wanted ``trace_id`` that exists; the table is cut down to them first."""
    return latest_traces(keep_matching(traces, ids, "trace_id"))


def summarize_result(result: Column) -> Column:
    """A tool's JSON result as counts, ids and flags - never its content.

    Struct fields (one group filled, by shape): ``candidate_count`` and ``candidate_knowledge_ids``
    for ``results``; ``topic_count``; ``related_count``; ``error``; ``keys`` of any other object;
    ``value``, the text of anything that is no object.
    """
    parsed = F.try_parse_json(result)
    shape = F.schema_of_variant(parsed)
    is_object = F.coalesce(shape.startswith("OBJECT"), F.lit(False))

    def items(name: str) -> Column:
        return F.try_variant_get(parsed, f"$.{name}", "array<variant>")

    results, topics, related = items("results"), items("topics"), items("related_topics")
    objects = F.filter(results, lambda r: F.schema_of_variant(r).startswith("OBJECT"))
    ids = F.transform(objects, lambda r: F.try_variant_get(r, "$.knowledge_id", "string"))
    has_error = F.array_contains(F.json_object_keys(result), "error")
    shape_no = (
        F.when(~is_object, 5)
        .when(results.isNotNull(), 0).when(topics.isNotNull(), 1).when(related.isNotNull(), 2)
        .when(has_error, 3).otherwise(4)
    )
    # The text of a JSON string is the string itself, of anything else its JSON.
    text = F.coalesce(F.try_variant_get(parsed, "$", "string"), result)
    return F.struct(
        F.when(shape_no == 0, F.size(results)).alias("candidate_count"),
        F.when(shape_no == 0, ids).alias("candidate_knowledge_ids"),
        F.when(shape_no == 1, F.size(topics)).alias("topic_count"),
        F.when(shape_no == 2, F.size(related)).alias("related_count"),
        F.when(shape_no == 3, F.try_variant_get(parsed, "$.error", "string")).alias("error"),
        F.when(shape_no == 4, F.array_sort(F.json_object_keys(result))).alias("keys"),
        F.when(shape_no == 5, F.substring(text, 1, 200)).alias("value"),
    )
