"""The embedding job embeds what changed and nothing else."""

import pytest

from lorekeep import schemas as S
from lorekeep.operators import embedding
from lorekeep.plans import jobs
from lorekeep.sources import files


def publish(spark, base, rows):
    files.publish({jobs.ELIGIBLE: spark.createDataFrame(rows, S.AGENT_ELIGIBLE)}, base)


def vectors(spark, base):
    rows = files.read_table(spark, base, "semantic/knowledge_embeddings", S.EMBEDDINGS).collect()
    return {r["knowledge_id"]: (r["topic_id"], r["title"], r["summary"], r["embedding_model"], list(r["embedding"])) for r in rows}


def test_only_changed_texts_reach_the_embedder(spark, tmp_path):
    base, log = str(tmp_path / "lake"), tmp_path / "calls"
    log.mkdir()

    def counting(texts, folder=str(log)):
        import os
        import uuid

        from lorekeep.operators.embedding import hashed_words

        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write("\n".join(texts))
        return hashed_words(texts)

    def embedded():
        found = sorted(line for p in log.iterdir() for line in p.read_text().split("\n") if line)
        for p in log.iterdir():
            p.write_text("")
        return found

    rows = [(f"k{i}", "t", f"Title {i}", f"text number {i}") for i in range(6)]
    publish(spark, base, rows)
    jobs.index(spark, base, counting)
    assert embedded() == sorted(r[3] for r in rows)
    # k0 goes, k1 has another text, k2 another title, k9 is new, the others stay.
    later = [("k1", "t", "Title 1", "another text"), ("k2", "t", "Renamed", "text number 2"), *rows[3:], ("k9", "t", "New", "text number 9")]
    publish(spark, base, later)
    jobs.index(spark, base, counting)
    assert embedded() == ["another text", "text number 9"]
    refreshed = vectors(spark, base)
    jobs.index(spark, base, counting, full=True)
    assert len(embedded()) == 6 and vectors(spark, base) == refreshed and set(refreshed) == {"k1", "k2", "k3", "k4", "k5", "k9"}
    jobs.index(spark, base, counting, model="another")  # vectors of another model are of no use
    assert len(embedded()) == 6


def test_nothing_eligible_is_an_error(spark):
    empty = spark.createDataFrame([], S.AGENT_ELIGIBLE)
    with pytest.raises(ValueError):
        embedding.refresh_index(empty, spark.createDataFrame([], S.EMBEDDINGS), embedding.F.current_timestamp())
