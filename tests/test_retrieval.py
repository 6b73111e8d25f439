"""Ranking against brute force written out in plain Python, on small fixtures."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorekeep import schemas as S
from lorekeep.functions.governance import cosine
from lorekeep.functions.text import tokens
from lorekeep.operators import evaluation, hybrid, lexical, questions, semantic

WORDS = "the a of red blue fish bird tree stone river cloud wind rain snow sun moon star sea sand hill".split()


def text(rng, length):
    return " ".join(rng.choices(WORDS, weights=[40, 30, 20] + [3] * (len(WORDS) - 3), k=length))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(7)
    rows = [(f"k{i:03d}", f"t{i % 3}", text(rng, rng.randint(0, 3)), text(rng, rng.randint(1, 40))) for i in range(120)]
    return rows + [("k900", "t0", "", ""), ("k901", "t0", "Red RED", "red fish\tred"), ("k902", "t1", "only", "unique wordling")]


@pytest.fixture(scope="module")
def corpus(spark, docs):
    return spark.createDataFrame(docs, S.AGENT_ELIGIBLE).repartition(5).cache()


@pytest.fixture(scope="module")
def asked():
    rng = random.Random(8)
    return [(f"q{i}", text(rng, rng.randint(1, 12))) for i in range(20)] + [
        ("q90", "nothing matches this"), ("q91", "red red fish"), ("q92", "the"), ("q93", "")]


@pytest.fixture(scope="module")
def questions_df(spark, asked):
    return spark.createDataFrame(asked, "query_id string, question string")


def words(value):
    return value.lower().split()


def brute_bm25(docs, asked, k):
    bags = {d[0]: words(f"{d[2]} {d[3]}") for d in docs}
    n, mean = len(bags), sum(map(len, bags.values())) / len(bags)
    df = {w: sum(w in bag for bag in bags.values()) for bag in bags.values() for w in bag}
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    out = {}
    for qid, question in asked:
        scores = []
        for kid, bag in bags.items():
            score = 0.0
            for w in words(question):
                f = bag.count(w)
                score += idf.get(w, 0.0) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(bag) / mean))
            scores.append((-round(score, 9), kid))
        out[qid] = [(kid, -s) for s, kid in sorted(scores)[:k]]
    return out


def lists(df, score="score"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["knowledge_id"], r[score]))
    return out


def same(got, expected):
    assert got.keys() == expected.keys()
    for key in expected:
        assert [g[0] for g in got[key]] == [e[0] for e in expected[key]], key
        assert [g[1] for g in got[key]] == pytest.approx([e[1] for e in expected[key]], abs=1e-8)


def test_tokens_split_like_python(spark):
    values = ["A  b\tC\n", "", "  ", "x y z", "É\x1cß", "end\r\n"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(tokens(F.col("v"))).collect()] == [words(v) for v in values]


def test_bm25_matches_brute_force(docs, corpus, asked, questions_df):
    same(lists(lexical.bm25_top(questions_df, corpus, 10)), brute_bm25(docs, asked, 10))


def test_bm25_in_small_blocks_and_several_passes(docs, corpus, asked, questions_df, monkeypatch):
    monkeypatch.setattr(questions, "TEXT_BYTES", 200)
    monkeypatch.setattr(lexical, "BLOCK_QUESTIONS", 3)
    monkeypatch.setattr(lexical, "BLOCK_CELLS", 64)
    same(lists(lexical.bm25_top(questions_df, corpus, 7)), brute_bm25(docs, asked, 7))


def test_bm25_statistics_belong_to_the_filtered_corpus(docs, corpus, asked, questions_df):
    part = [d for d in docs if d[1] == "t1"]
    same(lists(lexical.bm25_top(questions_df, corpus.where("topic_id = 't1'"))), brute_bm25(part, asked, 10))


def test_bm25_negative_scores_rank_below_no_match(spark):
    """Every word in most documents: the mean idf, and with it every score, is negative."""
    rows = [(f"k{i}", "t", "", "same words") for i in range(5)] + [("k9", "t", "", "zzz")]
    df = spark.createDataFrame(rows, S.AGENT_ELIGIBLE)
    asked = [("q", "same")]
    got = lists(lexical.bm25_top(spark.createDataFrame(asked, "query_id string, question string"), df, 10))
    same(got, brute_bm25(rows, asked, 10))


def test_bm25_with_a_third_of_the_corpus_being_copies(spark, docs, asked, questions_df):
    rows = docs + [(f"c{i:03d}", "t0", "red", "red fish sea") for i in range(60)]
    df = spark.createDataFrame(rows, S.AGENT_ELIGIBLE).repartition(3)
    same(lists(lexical.bm25_top(questions_df, df, 10)), brute_bm25(rows, asked, 10))


def test_bm25_empty_corpus(corpus, questions_df):
    assert lexical.bm25_top(questions_df, corpus.limit(0)).count() == 0


def test_lexical_search_carries_details_and_puts_the_exact_term_first(corpus, spark):
    asked = spark.createDataFrame([("q", "wordling")], "query_id string, question string")
    first = lexical.lexical_search(asked, corpus, 3).where("rank = 1").first()
    assert (first["knowledge_id"], first["title"], first["summary"]) == ("k902", "only", "unique wordling")


# ---- cosine ------------------------------------------------------------------------------------

def brute_cosine(vectors, asked, k):
    out = {}
    for qid, q in asked:
        scores = []
        for kid, v in vectors:
            norm = math.sqrt(sum(x * x for x in q)) * math.sqrt(sum(x * x for x in v))
            dot = sum(x * y for x, y in zip(q, v))
            scores.append((-round(dot / norm if norm else 0.0, 9) + 0.0, kid))
        out[qid] = [(kid, -s) for s, kid in sorted(scores)[:k]]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(9)
    made = [(f"k{i:03d}", [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    made += [(f"k9{i:02d}", made[0][1]) for i in range(30)]  # copies: ties decided by id
    return made + [("kzero", [0.0] * 8), ("kshort", [1.0, 2.0]), ("klong", [1.0] * 12)]


@pytest.fixture(scope="module")
def asked_vectors(vectors):
    rng = random.Random(10)
    return [("q0", vectors[0][1]), ("qzero", [0.0] * 8)] + [(f"q{i}", [rng.gauss(0, 1) for _ in range(8)]) for i in range(1, 25)]


@pytest.mark.parametrize("small", [False, True])
def test_cosine_matches_brute_force(spark, vectors, asked_vectors, monkeypatch, small):
    if small:
        monkeypatch.setattr(questions, "VECTOR_BYTES", 500)
        monkeypatch.setattr(semantic, "QUESTION_BLOCK", 2)
        monkeypatch.setattr(semantic, "ROW_BLOCK", 7)
    corpus = spark.createDataFrame(vectors, "knowledge_id string, embedding array<double>").repartition(4)
    asked = spark.createDataFrame(asked_vectors, "query_id string, embedding array<double>")
    same(lists(semantic.cosine_top(asked, corpus, 10)), brute_cosine(vectors, asked_vectors, 10))


@pytest.mark.parametrize("broadcast", [True, False])
def test_fifty_blocks_of_questions_and_one_scan(spark, vectors, asked_vectors, monkeypatch, broadcast):
    """Whatever the number of question blocks, the corpus is scanned by one node and the driver gets no question."""
    from pyspark.sql import DataFrame

    many = [(f"{q}-{n}", v) for n in range(40) for q, v in asked_vectors]
    monkeypatch.setattr(questions, "VECTOR_BYTES", 1600)
    monkeypatch.setattr(questions, "CORPUS_ROWS", 50)
    monkeypatch.setattr(questions, "HELD_ROWS", 3000)
    if not broadcast:
        monkeypatch.setattr(questions, "fits_broadcast", lambda df: False)
        monkeypatch.setattr(questions, "GROUP_BYTES", 50_000)
    staged_blocks = []
    keep = questions.staged
    monkeypatch.setattr(questions, "staged", lambda df, name: staged_blocks.append(keep(df, name)) or staged_blocks[-1])
    for name in ("toArrow", "toPandas"):
        monkeypatch.setattr(DataFrame, name, lambda self: pytest.fail("rows on the driver"))
    corpus = spark.createDataFrame(vectors, "knowledge_id string, embedding array<double>").repartition(4)
    found = semantic.cosine_top(spark.createDataFrame(many, "query_id string, embedding array<double>"), corpus, 10)
    monkeypatch.undo()
    assert staged_blocks[0].count() >= 50
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("Join Inner") == 1  # corpus rows to blocks, blocks to best lists
    one = brute_cosine(vectors, asked_vectors, 10)
    same(lists(found), {q: one[q.rsplit("-", 1)[0]] for q, _ in many})


def test_few_questions_take_one_process_a_task(spark, docs, corpus, asked, questions_df):
    """Rows are not packed by a process of their own; tasks without rows and one of a single row count as well."""
    spread = corpus.repartition(40, "knowledge_id").union(corpus.limit(0))
    found = lexical.bm25_top(questions_df, spread, 10)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    same(lists(found), brute_bm25(docs, asked, 10))


@pytest.mark.parametrize("most", [1, 25, 10_000])
def test_lists_are_handed_on_and_begun_again(vectors, asked_vectors, monkeypatch, most):
    monkeypatch.setattr(questions, "HELD_ROWS", most)
    blocks = [pa.RecordBatch.from_pylist([{"query_id": q, "embedding": v} for q, v in asked_vectors[i::3]]) for i in range(3)]
    rows = [{"asked": None, "knowledge_id": k, "embedding": v} for k, v in vectors]

    def payload(batch):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as writer:
            writer.write_batch(batch)
        return sink.getvalue().to_pybytes()

    schema = pa.schema([("asked", pa.binary()), ("knowledge_id", pa.string()), ("embedding", pa.list_(pa.float64()))])
    stream = [rows[0] | {"asked": payload(b)} for b in blocks] + rows[1:]
    batches = [pa.RecordBatch.from_pylist(stream[i:i + 2], schema) for i in range(0, len(stream), 2)]  # copies of the first row in two of them
    got = {}
    for part in questions.best_lists(iter(batches), lambda q: semantic._Block(q, 4)):
        for r in part.to_pylist():
            got.setdefault(r["query_id"], []).append((-r["score"], r["knowledge_id"]))
    best = {q: [(k, -s) for s, k in sorted(found)[:4]] for q, found in got.items()}
    assert all(len(set(k for _, k in found)) == len(found) for found in got.values())  # no row twice
    same(best, brute_cosine(vectors, asked_vectors, 4))


def test_cosine_of_given_pairs(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([1.0, 0.0], [-3.0, 0.0]), ([0.0, 0.0], [1.0, 1.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, -1.0, 0.0]


def test_no_questions_gives_no_rows(spark, corpus, questions_df, either_join):
    assert lexical.bm25_top(questions_df.limit(0), corpus).count() == 0
    empty = spark.createDataFrame([], "query_id string, embedding array<double>")
    assert semantic.cosine_top(empty, corpus.withColumn("embedding", F.array(F.lit(1.0)))).count() == 0


# ---- merge, re-check ---------------------------------------------------------------------------

LIST = "query_id string, knowledge_id string, score double, rank int, topic_id string, title string, summary string"


def ranking(spark, *rows):
    return spark.createDataFrame([("q", k, float(s), i + 1, "t", title, "s") for i, (k, s, title) in enumerate(rows)], LIST)


@pytest.mark.parametrize("scores, expected", [([7, -1, 5, 1], [1.0, 0.0, 0.75, 0.25]), ([0.4, 0.4, 0.4], [1.0, 1.0, 1.0]), ([], [])])
def test_normalize(spark, scores, expected):
    df = ranking(spark, *[(f"k{i}", s, "") for i, s in enumerate(scores)])
    assert [r["score"] for r in sorted(hybrid.normalize(df).collect(), key=lambda r: r["rank"])] == expected


def test_merge_keeps_one_sided_candidates_and_semantic_details(spark):
    sem = ranking(spark, ("a", 0.9, "sem a"), ("b", 0.1, "sem b"))
    lex = ranking(spark, ("b", 7, "lex b"), ("c", 1, "lex c"))
    got = sorted(hybrid.merge(sem, lex).collect(), key=lambda r: r["rank"])
    assert [(r["knowledge_id"], r["title"], r["semantic_score"], r["lexical_score"], r["hybrid_score"]) for r in got] == [
        ("a", "sem a", 1.0, 0.0, 0.6), ("b", "sem b", 0.0, 1.0, 0.4), ("c", "lex c", 0.0, 0.0, 0.0)]
    assert [r["knowledge_id"] for r in hybrid.merge(sem, lex, 0.0, 1.0, top_n=1).collect()] == ["b"]
    assert hybrid.merge(sem, lex.limit(0)).count() == 2


def test_recheck_drops_stale_rows_and_keeps_order(spark, either_join):
    found = ranking(spark, ("a", 3, ""), ("b", 2, ""), ("c", 1, ""))
    live = spark.createDataFrame([("c",), ("a",), ("z",)], "knowledge_id string")
    kept = hybrid.recheck(found, live)
    assert sorted((r["rank"], r["knowledge_id"]) for r in kept.collect()) == [(1, "a"), (3, "c")]
    assert sorted((r["rank"], r["knowledge_id"]) for r in hybrid.rerank(kept, 5).collect()) == [(1, "a"), (2, "c")]


def test_search_overfetches_before_the_recheck(spark, corpus, either_join):
    asked = spark.createDataFrame([("q", "red fish", [1.0, 0.0])], "query_id string, question string, embedding array<double>")
    index = corpus.withColumn("embedding", F.array(F.lit(1.0), (F.substring("knowledge_id", 2, 3).cast("int") / 100).cast("double")))
    full = hybrid.search(asked, index, corpus, corpus, top_n=3)
    ranks = [r["knowledge_id"] for r in sorted(full.collect(), key=lambda r: r["rank"])]
    assert len(ranks) == 3
    fewer = corpus.where(F.col("knowledge_id") != ranks[0])
    again = hybrid.search(asked, index, corpus, fewer, top_n=3)
    got = [r["knowledge_id"] for r in sorted(again.collect(), key=lambda r: r["rank"])]
    assert len(got) == 3 and got[:2] == ranks[1:]
    assert [r["knowledge_id"] for r in hybrid.drift(index, fewer).collect()] == [ranks[0]]


# ---- evaluation --------------------------------------------------------------------------------

def test_hit_at_k(spark):
    rows = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("r", "a", 1)], "query_id string, knowledge_id string, rank int")
    expected = spark.createDataFrame([("q", "c"), ("s", "a")], "query_id string, knowledge_id string")

    def hits(k):
        return {r["query_id"]: r["hit"] for r in evaluation.hits_at_k(rows, expected, k).collect()}

    assert hits(2) == {"q": False, "r": False, "s": False}
    assert hits(3) == {"q": True, "r": False, "s": False}


def test_evaluation_of_grounded_and_reject_cases(spark, either_join):
    cases = spark.createDataFrame([
        ("g1", "x", "semantic", "grounded", ["a"], None, None), ("g2", "x", "lexical", "grounded", ["z"], None, None),
        ("r1", "x", "semantic", "governance_reject", [], "bad", "stale"),
    ], S.BENCHMARK_CASE)
    sem = spark.createDataFrame([("g1", "a", 0.9, 1), ("g1", "b", 0.5, 2), ("r1", "bad", 0.9, 1), ("r1", "a", 0.2, 2)],
                                "query_id string, knowledge_id string, score double, rank int")
    lex = spark.createDataFrame([("g1", "b", 2.0, 1), ("g2", "y", 1.0, 1)], sem.schema)
    eligible = spark.createDataFrame([("a",), ("b",)], "knowledge_id string")
    results = evaluation.eval_cases(cases, evaluation.candidates(sem, lex, eligible))
    by_id = {r["id"]: r for r in results.collect()}
    assert (by_id["g1"]["semantic_hit"], by_id["g1"]["lexical_hit"], by_id["g1"]["hybrid_hit"]) == (True, False, True)
    assert (by_id["g2"]["lexical_empty"], by_id["g2"]["semantic_empty"], by_id["g2"]["hybrid_hit"]) == (True, True, False)
    assert (by_id["r1"]["excluded_id_was_a_raw_candidate"], by_id["r1"]["excluded_id_correctly_dropped"]) == (True, True)
    assert by_id["g1"]["excluded_id_was_a_raw_candidate"] is None
    rates = {r["style"]: (r["n"], r["semantic_hits"], r["hybrid_emptys"]) for r in evaluation.eval_summary(results).collect()}
    assert rates == {"semantic": (1, 1, 0), "lexical": (1, 0, 1), "all": (2, 1, 1)}
    assert tuple(evaluation.rejection_summary(results).first()) == (1, 1, 1)
