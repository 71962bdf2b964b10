"""Scale checks on physical plans.

* no row-at-a-time Python UDF anywhere (``BatchEvalPython``);
* no single-partition exchange, except the two bounded cases: the 0-based
  rank over the final top 10 of the feed, and the run calendar of the
  expiry counts (one row per run day);
* scans read only the columns a query needs (never ``html`` or ``text``
  unless the query extracts from them).
"""

import re

import pytest

from conftest import SF_SMALL

import __spark_entry__ as E

SINGLE_PARTITION_OK = {"latest_candidates", "candidate_expired_count"}
STREAMS = {n for n in E.queries() if n.startswith("stream_")}
NAMES = [n for n in E.queries() if n not in STREAMS and n != "word_vectors" and n not in E.LLM_QUERIES]
WIDE = {"html", "text"}
USES_WIDE = {"candidate_admissions", "candidate_pool_asof", "latest_candidates", "candidate_expired_count",
             "page_titles", "page_blocks", "page_links", "access_class", "first_write_articles",
             "clean_text", "br_lines", "recent_reads", "corpus_lines", "segmented_lines", "corpus_mixed", "vocabulary",
             "nav_links", "page_nodes", "article_paragraphs", "ad_blocks",
             "pool_union", "parse_quarantine", "corpus_files", "saved_vectors",
             *(n for n in E.queries() if n.startswith("site_"))}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def unbounded_single_partition(plan: str) -> list[str]:
    """Single-partition exchanges that are not the final step of a global
    aggregate over partial results (one row per task)."""
    lines = plan.splitlines()
    bad = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            nxt = lines[i + 1] if i + 1 < len(lines) else ""
            if not ("Aggregate(keys=[]" in nxt and "partial_" in nxt):
                bad.append(line.strip())
    return bad


@pytest.mark.parametrize("name", NAMES)
def test_plan_is_distributed(spark, name):
    plan = plan_of(E.queries()[name](spark, SF_SMALL))
    assert "BatchEvalPython" not in plan
    if name not in SINGLE_PARTITION_OK:
        assert unbounded_single_partition(plan) == [], plan


@pytest.mark.parametrize("name", sorted(set(NAMES) - USES_WIDE))
def test_wide_columns_are_pruned(spark, name):
    plan = plan_of(E.queries()[name](spark, SF_SMALL))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    read = {c.split(":")[0] for s in schemas for c in s.split(",") if c}
    assert not (read & WIDE), (name, read)


def test_pool_plan_combines_map_side(spark):
    plan = plan_of(E.queries()["candidate_admissions"](spark, SF_SMALL))
    # first crawl per (url, run) is a partial + final hash aggregate around the shuffle
    assert plan.count("HashAggregate") + plan.count("ObjectHashAggregate") + plan.count("SortAggregate") >= 2


def test_history_uses_group_limit(spark):
    plan = plan_of(E.queries()["recent_reads"](spark, SF_SMALL))
    assert plan.count("WindowGroupLimit") >= 1
