"""Joins with reference data never shuffle the facts."""

import re

import pytest

from tests.conftest import SMALL
from vetrina.plans.registry import QUERIES
from vetrina.sources.reference_data import etim_feature_df, rules_df, seed_rules, uom_df


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, allowed", [("f11_normalize_features", set()), ("v05_v07_etim_gtin_sku", {"class_code"})])
def test_fact_rows_stay_where_they_are(spark, name, allowed):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert set(re.findall(r"Exchange hashpartitioning\((\w+)#", plan)) <= allowed


def test_literal_tables_have_a_size(spark):
    for df in (uom_df(spark), etim_feature_df(spark), rules_df(spark)):
        assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 20
    assert [r.rule_id for r in rules_df(spark).collect()] == [r["rule_id"] for r in seed_rules()]
    assert rules_df(spark, []).count() == 0
