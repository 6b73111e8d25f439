"""The summary of the evaluation holds the whole report: cases, rates by style and overall, rejections."""

import duckdb

import __spark_entry__ as contract
from lorekeep.operators import evaluation
from oracle import rows

FLAGS = [f"{m}_{what}" for what in ("hit", "empty") for m in evaluation.METHODS]
RESULT = "id string, type string, style string, " + ", ".join(f"{f} boolean" for f in FLAGS) + (
    ", excluded_id_was_a_raw_candidate boolean, excluded_id_correctly_dropped boolean")
COUNTS = ["n", *[f"{f}s" for f in FLAGS], "raw_candidates", "correctly_dropped"]


def reported(results):
    found = evaluation.summarize(results).collect()
    totals = {(r["type"], r["style"]): [r[c] for c in COUNTS] for r in found if r["part"] == "total"}
    cases = sorted((r["id"], r["type"], r["style"], *[r[c] for c in COUNTS]) for r in found if r["part"] == "case")
    assert len(found) == len(totals) + len(cases)
    return totals, cases


def test_every_part_of_the_report(spark):
    no, yes = False, True
    results = spark.createDataFrame([
        ("a", "grounded", "semantic", yes, no, yes, no, yes, no, None, None),
        ("b", "grounded", "semantic", yes, no, no, no, no, no, None, None),
        ("b", "grounded", "other", no, no, no, yes, yes, yes, None, None),
        ("r", "governance_reject", "lexical", yes, yes, yes, no, no, no, yes, yes),
        ("s", "governance_reject", "semantic", no, no, no, no, no, no, no, yes),
        ("t", "governance_reject", "semantic", no, no, no, no, no, no, yes, no),
        ("u", "something else", "semantic", yes, yes, yes, yes, yes, yes, None, None),
    ], RESULT)
    totals, cases = reported(results)
    assert totals == {
        ("grounded", "semantic"): [2, 2, 0, 1, 0, 1, 0, None, None],
        ("grounded", "lexical"): [0, 0, 0, 0, 0, 0, 0, None, None],
        ("grounded", "other"): [1, 0, 0, 0, 1, 1, 1, None, None],
        ("grounded", "all"): [3, 2, 0, 1, 1, 2, 1, None, None],
        ("governance_reject", "all"): [3, *[None] * 6, 2, 2],
    }
    assert cases == [
        ("a", "grounded", "semantic", 1, 1, 0, 1, 0, 1, 0, None, None),
        ("b", "grounded", "other", 1, 0, 0, 0, 1, 1, 1, None, None),
        ("b", "grounded", "semantic", 1, 1, 0, 0, 0, 0, 0, None, None),
        ("r", "governance_reject", "lexical", 1, *[None] * 6, 1, 1),
        ("s", "governance_reject", "semantic", 1, *[None] * 6, 0, 1),
        ("t", "governance_reject", "semantic", 1, *[None] * 6, 1, 0),
    ]


def test_a_report_without_cases(spark):
    totals, cases = reported(spark.createDataFrame([], RESULT))
    assert cases == [] and totals == {
        **{("grounded", style): [*[0] * 7, None, None] for style in ("semantic", "lexical", "all")},
        ("governance_reject", "all"): [0, *[None] * 6, 0, 0],
    }


def test_the_query_reports_all_cases_and_rates(spark, tmp_path):
    words = "red fish swim past blue stone while river cloud wind and rain snow over sun moon star".split()
    texts = [" ".join(words[(i * k) % 17] for k in range(1, 9 + i % 3)) for i in range(1, 25)]
    made = {
        "documents": ([(i, t, "en", "web") for i, t in enumerate(texts, 1)], "doc_id long, text string, lang string, source string"),
        "labels": ([(i, i % 5, int(i == 7)) for i in range(1, 25)], "doc_id long, quality int, toxic int"),
        "benchmark": ([(i, texts[i - 1] if i % 2 else "Past blue " + texts[i - 1][:20]) for i in range(1, 13)], "item_id long, text string"),
        "embeddings": ([(i, [1.0, i / 10, (i * 7 % 5) / 3]) for i in range(1, 25)], "vec_id long, embedding array<float>"),
        "part": ([(i, 1, f"part {i}", f"brand {i % 3}", "kind") for i in range(1, 60)],
                 "p_partkey long, p_size int, p_name string, p_brand string, p_type string"),
        "supplier": ([(i, f"source {i}", i % 4) for i in range(11)], "s_suppkey long, s_name string, s_nationkey int"),
    }
    con = duckdb.connect()
    for name, (data, schema) in made.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    df = contract.queries()["eval_summary"](spark, str(tmp_path))
    ours = df.collect()
    result = con.execute(contract.oracle_sql()["eval_summary"])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, ours) == rows(columns, result.fetchall())
    assert {r["id"] for r in ours if r["part"] == "case"} == {f"q_{i}" for i in range(1, 13)}
    n = {(r["type"], r["style"]): r["n"] for r in ours if r["part"] == "total"}
    assert n["grounded", "semantic"] + n["grounded", "lexical"] == n["grounded", "all"] == 12 - n["governance_reject", "all"]
    assert min(n.values()) > 0
    assert any(r["semantic_hits"] for r in ours if r["type"] == "grounded" and r["part"] == "total")
