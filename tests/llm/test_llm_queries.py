import pytest

from quillspark.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, sf, name):
    from duck import connect, rows

    got, want = QUERIES[name](spark, sf).toPandas(), connect(sf).execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
