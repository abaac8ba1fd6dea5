"""The SQL of the training-data operators against their queries on the smallest tables."""

import pytest

from tallyworks.llm.queries import ORACLE_SQL, QUERIES
from tests.test_oracle import SF, duck, rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_llm_query_matches_sql(spark, duck, name):  # noqa: F811
    found = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(found.columns)
    assert rows(found.columns, found.collect()) == rows(names, want.fetchall())
