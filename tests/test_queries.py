"""Every query with SQL gives the rows of its SQL; the others run."""

import pytest

from tests.compare import compare, duck
from veriframe.plans import corpus as K
from veriframe.plans import oracles, queries

SF = "/root/testdata/sf0.001"
SQL = oracles.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_sql_has_queries():
    assert set(SQL) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, con, name):
    query = queries.queries()[name]
    if name in SQL:
        assert compare(spark, con, name, query, SQL[name], SF) is None
    else:
        assert query(spark, SF).count() > 0


def test_plans(spark):
    """Filters and columns reach the scan; no Python; five rows a record."""
    long = queries.queries()["all_fields_long"](spark, SF)
    plan = long._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    assert long.groupBy("record_id").count().filter("count != 5").count() == 0
    fuzzy = queries.queries()["brand_verdict_fuzzy"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in fuzzy and "ArrowEval" not in fuzzy
    flagship = queries.queries()["abv_net_verdict"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "p_name" not in flagship.split("ReadSchema")[1].split("\n")[0]


def test_merged_warning_joins_every_second_read(spark):
    """A read meets each of its lines and the whole read, the line with the header (6) among them."""
    rows = queries.queries()["merged_warning"](spark, SF)
    reads = K.reads(spark, SF).count()
    assert {r["line_id"]: r["count"] for r in rows.groupBy("line_id").count().collect()} == dict.fromkeys(range(K.N_LINES + 1), reads)
    line = {r["record_id"]: r["text"].strip() for r in K.lines(spark, SF).filter("line_id = 6").collect()}
    for r in rows.filter("line_id = 6").collect():
        if line[r["record_id"]]:
            assert r["text"].endswith(line[r["record_id"]]) and "Surgeon" not in r["text"]
