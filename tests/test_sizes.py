"""Queries whose tasks must not grow with their tables."""

import os

import duckdb
import pytest

from sedge.operators import blocks, grounding, tables as K
from sedge.plans import application, catalogue
from tests.test_queries import rows

DATA = "/root/testdata/sf0.001"


def lines(spark, folder, found, suppliers=()):
    """Tables of (order, part, supplier) lines, their orders and suppliers (key, nation)."""
    spark.createDataFrame(found, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(sorted({(o, 10 * (o % 3)) for o, *_ in found} | {(999, 7)}), "o_orderkey long, o_custkey long").write.parquet(f"{folder}/orders.parquet")
    if suppliers:
        spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey long").write.parquet(f"{folder}/supplier.parquet")


def agrees(spark, name, folder):
    got, con = catalogue.QUERIES[name](spark, folder).toPandas(), duckdb.connect()
    for f in os.listdir(folder):
        path = f"{folder}/{f}"
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    assert rows(got) == rows(con.execute(catalogue.ORACLE_SQL[name]).fetchdf())
    return got


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, keys", [("shared_elements", "part#"), ("blocked_pairs", "a#"), ("retracted_sources", "o_orderkey#"), ("overlapping_arrays", "gap#")])
def test_parts_follow_rows(spark, tmp_path, monkeypatch, name, keys):
    monkeypatch.setattr(K, "ROWS", 10, raising=False)
    lines(spark, str(tmp_path), [(i * 5 % 33, i * 7 % 6, i * i % 20) for i in range(120)], [(i, i % 2) for i in range(20)])
    parts = 13 * (4 if name == "blocked_pairs" else 1)
    found = [x for x in plan(catalogue.QUERIES[name](spark, str(tmp_path))).split("\n") if f", {parts})" in x and "hashpartitioning(" + keys in x]
    assert found  # more rows, more partitions
    assert len(agrees(spark, name, str(tmp_path)))


def test_shared_elements_meets_what_is_shared(spark, tmp_path):
    # 300 suppliers of one nation: 44,850 pairs, of which one shares a part.
    lines(spark, str(tmp_path), [(i, i, i) for i in range(300)] + [(0, 5, 7), (1, 5, 7), (2, 5, None)], [(i, 1) for i in range(300)] + [(300, None)])
    assert [(r.a, r.b, r.shared) for r in agrees(spark, "shared_elements", str(tmp_path)).itertuples()] == [(5, 7, 1)]
    p = plan(catalogue.QUERIES["shared_elements"](spark, str(tmp_path)))
    assert "array_intersect" not in p and any("Join" in x and "part#" in x for x in p.split("\n"))


def test_withdrawn_and_missing_sources(spark, tmp_path):
    lines(spark, str(tmp_path), [(1, 1, 3), (1, 2, 13), (2, 1, 3), (2, 1, 4), (2, 2, 4), (3, 1, None), (6, 9, 5)])
    got = agrees(spark, "retracted_sources", str(tmp_path))
    assert sorted(zip(got["o_orderkey"], got["sources"])) == [(2, 1), (6, 1), (999, 0)]


def test_overlap_counts_rows_without_rule(spark, tmp_path):
    lines(spark, str(tmp_path), [(3, 1, 4), (3, 1, None), (3, 2, None), (6, 2, 4), (6, None, 4), (1, 1, 5)])
    assert len(agrees(spark, "overlapping_arrays", str(tmp_path)))


def test_overlap_takes_every_gap(spark, tmp_path, monkeypatch):
    # Customers of any number and rows without one; before, nine tenths of the customers were left out.
    monkeypatch.setattr(application, "TOGETHER", 2, raising=False)
    spark.createDataFrame([(o, p, r) for o in range(1, 6) for p in range(o, 9) for r in (p, p % 3, 7)], "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 3), (2, 3), (3, 10), (4, 17), (5, None)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = agrees(spark, "overlapping_arrays", str(tmp_path))
    assert sorted(got["gap"].fillna(0)) == [0, 3, 10, 17]


def test_repaired_reads_texts_few_times(spark):
    x = spark.createDataFrame([("de", i, 0, "mit süße Äpfel essen" if i < 8 else "mit susse apfel susse Äpfel essen") for i in range(12)], "scope string, doc long, position long, text string")
    found = blocks.repaired(x)
    # The whole texts, and once more the words that may change; before, each of six counts read and moved them again.
    assert plan(found).count("Scan ExistingRDD") <= 2
    assert {r.n_repaired for r in found.collect() if r.doc >= 8} == {1}


def test_grounded_claims_judges_sentences_once(spark):
    claim = "Sleep may consolidate memory and is associated with later recall of events."
    answers = spark.createDataFrame([(i, claim) for i in range(3)], "id long, text string")
    rules = spark.createDataFrame([(1, "Sleep may consolidate memory and is associated with later recall")], "id long, text string")
    evidence = spark.createDataFrame([(1, 4, 9, "said")], "rule_id long, source_id long, evidence_id long, quote string")
    found = grounding.grounded_claims(answers, rules, evidence)
    assert "Scan ExistingRDD" not in plan(found) and "rlike" not in plan(found).lower()  # claims have been judged when they are bound
    assert sorted((r.id, r.claim, r.source_id, r.citation_index, r.status) for r in found.collect()) == [(i, claim, 4, 1, "resolved") for i in range(3)]
