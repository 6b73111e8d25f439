"""The labelled cases of the evaluation."""

from lorekeep.testbed import retrieval
from lorekeep.testbed.registry import Context

WORDS = "red fish swims past blue stone while river cloud wind and rain snow over sun moon star".split()
TEXTS = [
    (1, " ".join(WORDS)), (2, "A  " + " ".join(WORDS[:9]).upper() + "\nend"), (3, "red fish"), (4, None), (5, ""),
    (6, "over " * 40 + " ".join(WORDS[4:14])), (7, " ".join(WORDS)), (None, " ".join(WORDS)), (8, "bluer stones"), (10, "Red"),
]
ASKED = [
    (1, " ".join(WORDS)), (2, " ".join(WORDS[1:8])), (3, "d " + " ".join(WORDS[1:6]) + " whi"), (4, " ".join(WORDS[5:12])), (5, "red fish"),
    (6, "fish swims past"), (7, "blue wind rain"), (8, "over over over over over over over"), (9, "river cloud  wind and rain snow over"),
    (10, ""), (11, None), (12, "past blue stone while river snow cloud"), (13, "é"), (14, "swims past blue stone while river"),
]


def tables(spark, folder):
    texts = [(i, t, "en", "web") for i, t in TEXTS]
    made = {
        "documents": (texts + texts[:2], "doc_id long, text string, lang string, source string"),
        "labels": ([(1, 1, 0), (2, 0, 0), (6, 0, 1), (6, 0, 1)], "doc_id long, quality int, toxic int"),
        "benchmark": (ASKED, "item_id long, text string"),
        "embeddings": ([(i, [1.0, float(i)]) for i, _ in ASKED], "vec_id long, embedding array<float>"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_first_document_that_holds_a_question(spark, tmp_path, monkeypatch, either_join):
    c = Context(spark, tables(spark, tmp_path))
    staged, names = retrieval.staged, []
    monkeypatch.setattr(retrieval, "staged", lambda df, name: names.append(name) or staged(df, name))
    got = {r["query_id"]: r["within"] for r in retrieval._within(c).collect()}
    expected = {}
    for item, question in ASKED:
        if question:
            held = [f"know_{i}" for i, text in TEXTS if i and text and question.lower() in text.lower()]
            if held:
                expected[f"q_{item}"] = min(held)
    assert got == expected
    assert len(expected) > 5
    labelled = {r["id"]: (r["type"], sorted(r["expected_knowledge_ids"])) for r in retrieval._label(c).collect()}
    assert labelled["q_2"] == ("governance_reject", ["know_1", "know_2"])
    assert names == ["asked", "asked"] and list(c._landed) == ["b_questions"]  # texts are written nowhere for it
