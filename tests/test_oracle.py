"""D checks: every query with an oracle equals its DuckDB SQL (small scale)."""

import pytest

from conftest import SF_SMALL

import __spark_entry__ as E
from scripts.check_oracle import canon, duck

SLOW = {"word_vectors"}
NAMES = [n for n in E.queries() if n in E.oracle_sql()]


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert canon(rows, df.columns) == canon(res.fetchall(), ocols)


def test_every_query_has_an_oracle_or_is_listed():
    # the training-data operators state in their own tests what SQL cannot express
    missing = set(E.queries()) - set(E.oracle_sql()) - set(E.LLM_QUERIES)
    assert missing <= SLOW


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["rank", "title", "pb_time", "url"]
    assert 0 < df.count() <= 10
