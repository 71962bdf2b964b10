"""Pages are tokenised and ruled in one pass: bounded batches, no joins of a page's elements."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL

import __spark_entry__ as E
from newsflux.operators import extract as X
from newsflux.sources import nodes as N


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tokeniser_hands_over_small_batches():
    html = "<html><body><div>" + "<p>some words of a page</p>" * 200 + "</div></body></html>"
    n = 10 * N.OUT_BYTES // len(html)
    given = pa.RecordBatch.from_pydict({"page_id": list(range(n)), "html": [html] * n},
                                       schema=pa.schema([("page_id", pa.int64()), ("html", pa.string())]))
    got = list(N._tokenise(iter([given])))
    assert sum(b.num_rows for b in got) == n
    assert max(b.num_rows for b in got) < n // 5


@pytest.mark.parametrize("name, python", [("site_eastmoney", 1), ("site_reports", 1), ("site_stocks", 1), ("site_hexun", 1),
                                          ("site_research", 1), ("site_tencent", 2), ("page_nodes", 1), ("nav_links", 1)])
def test_a_page_is_tokenised_once_and_not_joined_with_itself(spark, name, python):
    plan = plan_of(E.queries()[name](spark, SF_SMALL))
    assert plan.count("MapInArrow") == python
    assert plan.count("Join") <= 2  # with the pages' urls, and with slides


def test_trees_and_element_rows_give_the_same(spark):
    html = "<div class='rich-text'><h2>H</h2><p>a<img src=' i.png '></p><p> b </p></div>"
    pages = spark.createDataFrame([(1, html), (2, "<p>none</p>"), (3, None)], "page_id long, html string")
    got = [X.wallstreet_article(n).collect() for n in (N.trees(pages), N.nodes(pages))]
    assert got[0] == got[1]
    assert [(r.page_id, r.blocks) for r in got[0]] == [(1, ["H", "i.png", "b"])]


def test_pages_of_one_id_are_one_tree_and_pages_without_id_stay_apart(spark):
    pages = spark.createDataFrame([(1, "<p>a</p>"), (1, "<p>b</p>"), (None, "<p>c</p>"), (None, "<p>d</p>")],
                                  "page_id long, html string")
    got = N.trees(pages).select("page_id", F.transform("nodes", lambda n: n["text"]).alias("texts")).collect()
    assert sorted((r.page_id or 0, sorted(r.texts)) for r in got) == [(0, ["c"]), (0, ["d"]), (1, ["a", "b"])]
