"""Every query of this package, by name; importing it registers them."""

from __future__ import annotations

from lorekeep.llm import (  # noqa: F401
    chat_format, line_crf, line_dedup, markov_lm, mixing, near_dedup, nearest, online_packing, packing, prefix_trie, quality_rules, spelling, toxicity,
)
from lorekeep.llm.common import ORACLES, QUERIES, query


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def all_queries():
    return dict(QUERIES)


def all_oracles():
    return dict(ORACLES)
