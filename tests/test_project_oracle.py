"""The knowledge base of the generated project, and single operators, against DuckDB on the smallest tables."""

import pytest

from factloom.plans import project, trials
from tests.test_oracle import SF, duck, text  # noqa: F401


QUERIES, ORACLE_SQL = {**project.QUERIES, **trials.QUERIES}, {**project.ORACLE_SQL, **trials.ORACLE_SQL}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_the_oracle(spark, duck, name):  # noqa: F811
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    own = sorted(tuple(text(r[c]) for c in columns) for r in found.collect())
    result = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert own == sorted(tuple(text(r[i]) for i in at) for r in result.fetchall())
