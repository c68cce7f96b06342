"""Every query of the core that has SQL agrees with it on whole tables."""

import pytest

from stratalens.plans import registry
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_agrees(spark, name):
    same, got, expected = compare(spark, name)
    assert same
    assert got == expected
