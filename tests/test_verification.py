"""Sweeps over texts that cite more than once."""

from datetime import datetime

import pytest

from lexloom.operators import corpus, verification
from lexloom.plans import research
from workload import corpus_queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of eight briefs with two case citations each: the one of their form, and a neutral one."""
    root = str(tmp_path_factory.mktemp("tables"))

    def write(name, rows, columns):
        spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{root}/{name}.parquet")

    orders = [(i, i % 3, "OFP"[i % 3], 1.0, datetime(2000 + i, 3, 4), "1-URGENT") for i in range(1, 9)]
    write("orders", orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string")
    write("customer", [(i, f"C{i}", i, 1.0, "BUILDING") for i in range(3)], "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    write("nation", [(i, f"N{i}", 0) for i in range(3)], "n_nationkey int, n_name string, n_regionkey int")
    write("part", [(i, f"part {i}", f"Brand#1{i}", "SMALL", i, 1.0) for i in range(3)], "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    return root


def test_summary_checks_every_case(spark, folder):
    rows = corpus_queries.verification_summary(spark, folder).where("kind = 'case'").collect()
    assert sum(r.total for r in rows) == 16
    assert [r.unchecked for r in rows] == [0] * 4


def test_total_checks_every_case(spark, folder):
    """Of the 40 citations only eight Articles, eight Orders and Acts that are unknown or partial stay open."""
    summary = corpus_queries.verification_summary(spark, folder).collect()
    total = {r.part: r for r in corpus_queries.verification_total(spark, folder).collect()}
    assert total["all"].total == 40 and total["empty"].total == 0
    assert total["all"].unchecked == sum(r.unchecked for r in summary if r.kind != "case")


@pytest.mark.parametrize("budget, checked", [(None, 30), (20, 20), (1, 1), (0, 0)])
def test_without_a_budget_all_cases_are_checked(spark, folder, budget, checked):
    t = corpus_queries.Tables(spark, folder)
    text = "; ".join(f"(2014) 9 SCC {n}" for n in range(1, 31))
    texts = spark.createDataFrame([(1, text)], "id int, text string")
    rows = research.verify_texts(texts, "id", "text", corpus.uniform_view(t.corpus_sources()), t["acts"], t["sections"], t["aliases"], budget)
    verdicts = [r.verdict for r in rows.collect()]
    assert len(verdicts) == 30 and verdicts.count(verification.UNCHECKED) == 30 - checked
