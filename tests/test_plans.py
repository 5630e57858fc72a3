"""Plans: pruned and pushed-down scans, no products of tables."""

import pytest

import __spark_entry__ as entry


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_is_pruned_and_filters_are_pushed(spark, sf_dir):
    p = plan(entry.queries()["scan_lineitem_pruned"](spark, sf_dir))
    schema = p.split("ReadSchema: ")[1].split("\n")[0].strip()
    assert schema == "struct<l_quantity:double,l_returnflag:string,l_linestatus:string>"
    assert "GreaterThanOrEqual(l_quantity,45.0)" in p


@pytest.mark.parametrize("name", ["p5_found", "record_scores", "word_counts", "pattern_fields", "event_sessions", "policy_verdicts", "value_hits", "next_line_values", "longest_name_match"])
def test_no_products(spark, sf_dir, name):
    p = plan(entry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name", ["hit_classes", "structure_scores", "canonical_values", "char_trigrams", "ctc_greedy"])
def test_expressions_stay_in_the_jvm(spark, sf_dir, name):
    p = plan(entry.queries()[name](spark, sf_dir))
    assert "Python" not in p and "Pandas" not in p and "Arrow" not in p
