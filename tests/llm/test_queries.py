"""Every registered query of the subpackage runs whole on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
QUERIES = {n: q for n, q in entry.queries().items() if n[0] == "p" and n[1].isdigit() and not n.startswith("p1_")}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, name):
    got = QUERIES[name](spark, D)
    assert got.columns and len(set(got.columns)) == len(got.columns)
    got.write.format("noop").mode("overwrite").save()


def test_all_problems_are_there():
    assert {n.split("_")[0] for n in QUERIES} == {f"p{i}" for i in range(2, 11)}
