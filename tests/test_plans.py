"""Joins that must not send a model through the driver, whatever size its files suggest."""

import pytest
from varilume.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["coding_calls", "haplotype_consequences", "coding_transcripts", "haplotypes_core"])
def test_transcripts_are_not_broadcast(spark, name):
    """At sf0.001 all sizes lie under the default threshold; a plan that goes by them would broadcast transcripts at any size of model."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "CHROM" not in line]
    assert not joins and "SortMergeJoin" in plan
