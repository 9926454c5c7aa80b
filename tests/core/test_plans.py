"""Plans: no cartesian products, pruned scans, pushed filters, no Python where columns suffice."""

import pytest

from dossier.plans.queries import REGISTRY

DIR = "/root/testdata/sf0.001"
PYTHON = {"labels_fuzzy_join", "identity_ladder", "identity_batch", "reply_tool_use"}


def plan(spark, name):
    return REGISTRY[name](spark, DIR)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_no_cartesian_product_and_no_python(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p
    assert ("ArrowEvalPython" in p) == (name in PYTHON)


def test_scans_are_pruned(spark):
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in plan(spark, "eval_confusion")
    assert "text:string" not in plan(spark, "judgments_latest").split("== Physical Plan ==")[1]
    assert "ReadSchema: struct<doc_id:bigint,quality:bigint,toxic:bigint>" in plan(spark, "label_counts") or "ReadSchema: struct<doc_id:bigint,quality:int,toxic:int>" in plan(spark, "label_counts")


def scans(p):
    """The scans of a physical plan."""
    return [x for x in p.split("== Physical Plan ==")[1].split("\n") if "FileScan" in x]


def test_filters_reach_the_scan(spark):
    pushed = REGISTRY["round_run_log"](spark, DIR)._jdf.queryExecution().toString()
    assert any("GreaterThan(n_chars,500)" in x for x in scans(pushed))
    assert all("IsNotNull(doc_id)" in x for x in scans(plan(spark, "stats_two_by_two")))


def test_one_scan_for_all_branches(spark):
    documents = lambda name: sum("documents.parquet" in x for x in scans(plan(spark, name)))
    assert documents("ledger_union") == 1 and documents("eval_confusion") == 1 and documents("manifest_histogram") <= 2
