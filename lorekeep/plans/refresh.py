"""The batch refresh: four raw tables in, curated and semantic tables plus quarantine out."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import DataFrame

from lorekeep.operators import curate
from lorekeep.sources import files
from lorekeep.session import staged


class Refresh:
    """One run over one set of raw tables.

    Every checked table is computed once and staged in the shared folder, in key order: topics and
    sources, then knowledge, then reviews.  Output tables are plain selections of the staged ones.
    """

    def __init__(
        self, topics: DataFrame, sources: DataFrame, knowledge: DataFrame, reviews: DataFrame,
        stage: Callable[[DataFrame, str], DataFrame] = staged,
    ):
        self.raw = {"topics": topics, "sources": sources, "knowledge": knowledge, "reviews": reviews}
        self._stage = stage

    @cached_property
    def checked_topics(self) -> DataFrame:
        return self._stage(curate.check_topics(self.raw["topics"]), "topics")

    @cached_property
    def checked_sources(self) -> DataFrame:
        return self._stage(curate.check_sources(self.raw["sources"]), "sources")

    @cached_property
    def checked_knowledge(self) -> DataFrame:
        checked = curate.check_knowledge(
            self.raw["knowledge"], curate.valid(self.checked_topics), curate.valid(self.checked_sources)
        )
        return self._stage(checked, "knowledge")

    @cached_property
    def checked_reviews(self) -> DataFrame:
        checked = curate.check_reviews(self.raw["reviews"], curate.valid(self.checked_knowledge))
        return self._stage(checked, "reviews")

    @property
    def catalog(self) -> DataFrame:
        return curate.catalog(self.checked_knowledge)

    @property
    def eligible(self) -> DataFrame:
        return curate.agent_eligible(self.catalog)

    @property
    def topics(self) -> DataFrame:
        return curate.dim_topic(self.checked_topics)

    @property
    def sources(self) -> DataFrame:
        return curate.dim_source(self.checked_sources)

    @cached_property
    def summary(self) -> DataFrame:
        return self._stage(curate.topic_summary(self.catalog), "topic_summary")

    def tables(self) -> dict[str, DataFrame]:
        """The eight output tables by name."""
        return {
            "curated/dim_topic": self.topics,
            "curated/dim_source": self.sources,
            "curated/dim_knowledge": curate.dim_knowledge(self.checked_knowledge),
            "curated/fact_review": curate.fact_review(self.checked_reviews),
            "semantic/knowledge_catalog": self.catalog,
            "semantic/approved_knowledge": curate.approved(self.catalog),
            # Sorted inside each file, so a search within one topic skips most row groups.
            "semantic/agent_eligible_knowledge": self.eligible.sortWithinPartitions("topic_id"),
            "semantic/topic_knowledge_summary": self.summary,
        }

    def rejects(self) -> DataFrame:
        checked = {
            "raw_topics": (self.checked_topics, self.raw["topics"].columns),
            "raw_sources": (self.checked_sources, self.raw["sources"].columns),
            "raw_knowledge": (self.checked_knowledge, self.raw["knowledge"].columns),
            "raw_reviews": (self.checked_reviews, self.raw["reviews"].columns),
        }
        return curate.quarantine(checked)

    def run(self, warehouse: str, quarantine_dir: str, run_id: str | None = None) -> str:
        """Publish everything; returns the run id.

        All stages finish before the first table is replaced, so a failed run leaves the published
        tables as they were.
        """
        run_id = run_id or files.new_run_id()
        with ThreadPoolExecutor(2) as pool:  # the two parents do not wait for each other
            list(pool.map(lambda name: getattr(self, name), ["checked_topics", "checked_sources"]))
        tables = self.tables()  # building the selections computes every stage
        files.write_quarantine(self.rejects(), quarantine_dir, run_id)
        files.publish(tables, warehouse)
        return run_id
