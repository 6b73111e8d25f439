"""The n-gram ratio under few and many labels."""

import random

import pytest

from lorekeep.llm import quality_rules

GOOD, JUNK = [f"good{i}" for i in range(40)], [f"junk{i}" for i in range(40)]


@pytest.mark.parametrize("labelled", [4, 20, 150])
def test_threshold_and_verdicts_stay_whatever_the_labels(spark, documents, labelled):
    pick = random.Random(5)
    rows = [(i, " ".join(pick.choices(GOOD if i < 200 else JUNK, k=100))) for i in range(300)]
    labels = spark.createDataFrame([(i, 1) for i in range(labelled)], "doc_id long, quality int")
    docs = documents(rows)
    ratios, threshold = quality_rules.fit(docs, quality_rules.trusted_ids(labels))
    assert threshold == quality_rules.THRESHOLD
    kept = {r["doc_id"] for r in quality_rules.judge(docs, ratios, threshold).where("kept").collect()}
    assert kept == set(range(200))
