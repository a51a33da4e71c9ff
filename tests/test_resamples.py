"""The registered resamplings draw as often as the reference."""

import os

import pytest
from gleanery.plans import all_queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the shared tables")


@pytest.mark.parametrize("name", ["sta2_bootstrap_with_rechosen_threshold", "sta3_two_sample_bootstrap"])
def test_two_thousand_resamples(spark, name):
    assert sorted(r.b for r in all_queries()[name](spark, SF).select("b").collect()) == list(range(2000))
