"""Every operator with SQL gives what DuckDB gives, on the smallest tables."""

import pytest

from sievemark.llm import queries
from tests.test_oracles import SF, _plain, duck  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_operator_matches_sql(spark, duck, name):  # noqa: F811
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(_plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
