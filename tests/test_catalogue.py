import pytest

from chargelens.plans import catalogue
from tests.conftest import rows

NAMES = sorted(catalogue.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, duck, name):
    ours = catalogue.queries()[name](spark, "/root/testdata/sf0.01").toPandas()
    theirs = duck.execute(catalogue.oracle_sql()[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = rows(ours), rows(theirs)
    assert len(a) == len(b) > 0
    for x, y in zip(a, b, strict=True):
        for p, q in zip(x, y, strict=True):
            assert p == q or abs(float(p) - float(q)) < 2e-5
