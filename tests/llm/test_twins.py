"""Queries beside their SQL twins over the small supplied tables."""

import pytest
from twins import KINDS, duck, normal

from foliant.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_twin(spark, small_dir, name):
    df = QUERIES[name](spark, small_dir)
    twin = duck(small_dir).execute(SQL[name])
    assert {d[0]: KINDS[str(d[1])] for d in twin.description} == {f.name: f.dataType.simpleString() for f in df.schema.fields}
    mine = normal(df.columns, [tuple(r) for r in df.collect()])
    other = normal([d[0] for d in twin.description], twin.fetchall())
    assert mine[0] == other[0]
    assert len(mine[1]) == len(other[1]) > 0
    assert mine[1] == other[1]
