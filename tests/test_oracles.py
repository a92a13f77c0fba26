"""Every registered query of the card library runs; those with an oracle match it row by row."""

import pytest

from idweft.plans.job_oracles import ORACLE_SQL
from idweft.plans.queries import QUERIES
from tests.compare import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_oracle(spark, name):
    same_columns, ours, theirs, n = differences(spark, SF, QUERIES[name], ORACLE_SQL[name])
    assert same_columns and not ours and not theirs and n > 0


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)
