"""How often queries of ratchets read their findings."""

from __future__ import annotations

import pytest

from lodestone.plans import gate_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, most", [("ratchet_counted", 5), ("ratchet_valued", 5)])
def test_findings_are_read_a_few_times(spark, name, most):
    plan = gate_queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("Relation [l_orderkey") <= most
