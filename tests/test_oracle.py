"""Every registered query equals its DuckDB oracle on sf0.01 (sorted rows)."""

import math

import pytest

import __spark_entry__ as E
from tests.conftest import SF01


def canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else f"{round(v, 6):.6f}"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def rows(pdf):
    cols = sorted(pdf.columns)
    return sorted(tuple(canon(r[c]) for c in cols) for r in pdf.to_dict("records"))


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    sp = E.queries()[name](spark, SF01).toPandas()
    dk = duck.execute(E.oracle_sql()[name]).df()
    assert sorted(sp.columns) == sorted(dk.columns)
    assert len(sp) == len(dk)
    assert rows(sp) == rows(dk)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["source", "label"]
