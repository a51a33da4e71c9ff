"""The sixty features count certificates; they list none."""

import os

import pytest
from gleanery.plans import all_queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the shared tables")


def test_pages_are_not_given_their_certificates(spark):
    plan = all_queries()["mld1_sixty_features"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "row_number" not in plan
