"""Inputs derived from the driver tables (FIXTURES.md §2).

The reference reads crawl responses, a code table file, quote payloads and
JSON feeds; the driver lands none of those, so each is built here from the
given tables with plain column expressions. Every recipe is deterministic and
scales with its source table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Tables


# fixed values: forms of references on pages (up, here, query, fragment, root, host, scheme)
REFERENCES = ["../x", "./x", "?q=1", "#f", "/r/../s", "a/./b/../c", "//other.example/p/../q", "..", ".", "", "x?y=../z",
              "../../../up", "a/b/..", "mailto:a@b.example", "http://third.example/a/../b?c=d/./e"]


def crawl_log(t: Tables, pages: DataFrame | None = None) -> DataFrame:
    """events ⋈ pages on ``page_id = event_id % count(pages)``.

    Each event is one crawl of that page at ``ts``; a run is a UTC day.
    ``count(pages)`` is a scalar subquery, not a driver round trip. ``pages``
    may be a filtered projection of the pages table (it must keep
    ``page_id``); the modulus always counts the whole table.
    """
    pages = t.pages("page_id", "url") if pages is None else pages
    n_pages = t.pages("page_id").select(F.count(F.lit(1))).scalar()
    ev = (t.events("event_id", "ts", "user_id")
          .withColumn("page_id", F.col("event_id") % n_pages)
          .withColumn("run_start", F.date_trunc("DAY", "ts").cast("timestamp_ntz")))
    return ev.join(pages, "page_id")


def stock_code(k) -> Column:
    """Stock code of a part key: market (sh odd / sz even), a class digit
    (key % 7: 2 = bond, 5 = fund), then the key in base 36 with 5 digits: always
    8 characters. Beyond 36**5 keys codes repeat, like re-listed stocks."""
    k = F.col(k) if isinstance(k, str) else k
    return F.concat(F.when(k % 2 == 1, F.lit("sh")).otherwise(F.lit("sz")),
                    (k % 7).cast("string"),
                    F.lpad(F.conv((k % 36**5).cast("string"), 10, 36), 5, "0"))


def code_lines(t: Tables) -> DataFrame:
    """The ``code:name`` table file as (line_no, line): every 50th line has a
    second ':' (must be skipped); every 70th re-states the previous key's
    code with surrounding blanks (later line wins)."""
    p = t.part("p_partkey", "p_name", "p_brand")
    k = F.col("p_partkey")
    line = (F.when(k % 50 == 0, F.concat(stock_code(k), F.lit(":"), "p_name", F.lit(":"), "p_brand"))
            .when(k % 70 == 0, F.concat(F.lit(" "), stock_code(k - 1), F.lit(" : "), "p_name", F.lit(" ")))
            .otherwise(F.concat(stock_code(k), F.lit(":"), "p_name")))
    return p.select(k.alias("line_no"), line.alias("line"))


def stock_links(t: Tables, base: str = "http://quote.example.com/") -> DataFrame:
    """Stock-list page links as (line_no, href, label): label ``name(code)``;
    every 40th link is not a quote page (code length != 8); every 30th label
    has no '('."""
    p = t.part("p_partkey", "p_name")
    k = F.col("p_partkey")
    href = (F.when(k % 40 == 0, F.concat(F.lit(base), F.lit("list"), k.cast("string"), F.lit(".html")))
            .otherwise(F.concat(F.lit(base), stock_code(k), F.lit(".html"))))
    label = (F.when(k % 30 == 0, F.col("p_name"))
             .otherwise(F.concat("p_name", F.lit("("), stock_code(k), F.lit(")"))))
    return p.select(k.alias("line_no"), href.alias("href"), label.alias("label"))


def _cents_str(c) -> Column:
    """Integer cents -> ``d.dd`` text."""
    return F.concat(F.floor(c / 100).cast("string"), F.lit("."),
                    F.lpad((c % 100).cast("string"), 2, "0"))


def quote_lines(t: Tables) -> DataFrame:
    """Quote payloads ``var hq_str_<code>="name,open,prev,cur,…";`` per part;
    every 13th previous close is 0."""
    p = t.part("p_partkey", "p_name", "p_retailprice")
    k = F.col("p_partkey")
    c = F.floor(F.col("p_retailprice") * 100 + 0.5)
    prev = F.when(k % 13 == 0, F.lit(0)).otherwise(F.floor(c * 98 / 100))
    cur = F.floor(c * (100 + k % 11 - 5) / 100)
    payload = F.concat(F.lit("var hq_str_"), stock_code(k), F.lit('="'), "p_name", F.lit(","),
                       _cents_str(c), F.lit(","), _cents_str(prev), F.lit(","), _cents_str(cur),
                       F.lit(",0,0,2024-01-02,15:00:00\";"))
    return p.select(stock_code(k).alias("code"), payload.alias("payload"))


def watch_adds(t: Tables) -> DataFrame:
    """Watchlist additions: each line of an order adds its part's stock to the
    customer's list at ``o_orderdate + l_linenumber minutes``."""
    o = t.orders("o_orderkey", "o_custkey", "o_orderdate")
    li = t.lineitem("l_orderkey", "l_linenumber", "l_partkey")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.col("o_custkey").alias("user_id"), "l_orderkey", "l_linenumber", stock_code("l_partkey").alias("code"),
                    (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("l_linenumber")))
                    .alias("added_at"))


def holder_attrs(t: Tables) -> DataFrame:
    """Company-manager attributes per supplier (name, sex, age, edu, duty,
    start_time, intro)."""
    s = t.supplier("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    k = F.col("s_suppkey")
    return s.select(
        "s_suppkey",
        F.col("s_name").alias("name"),
        F.when(F.col("s_nationkey") % 2 == 0, "M").otherwise("F").alias("sex"),
        (F.lit(30) + k % 35).cast("string").alias("age"),
        F.when(F.col("s_nationkey") % 3 == 0, "PhD").when(F.col("s_nationkey") % 3 == 1, "MBA")
        .otherwise("BSc").alias("edu"),
        F.when(F.col("s_acctbal") > 0, "director").otherwise("manager").alias("duty"),
        F.date_format(F.date_add(F.lit("2010-01-01").cast("date"), (k % 3000).cast("int")), "yyyy-MM-dd")
        .alias("start_time"),
        F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("intro"))


def holder_pairs(t: Tables) -> DataFrame:
    """Holder -> stock records in arrival order ``(l_orderkey, l_linenumber)``;
    rows shipped before 1995 form the stored snapshot, the rest the delta."""
    li = t.lineitem("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return li.select("l_suppkey", stock_code("l_partkey").alias("stock_id"),
                     "l_orderkey", "l_linenumber",
                     (F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp_ntz")).alias("in_base"))


def signups(t: Tables) -> DataFrame:
    """signup events -> (event_id, ts, username, email): usernames share emails,
    every third signup comes with another email than its user's usual one, every
    eleventh without an email and every thirteenth without a username."""
    e = t.events("event_id", "ts", "user_id", "event_type").where(F.col("event_type") == "signup")
    return e.select("event_id", "ts",
                    F.when(F.col("event_id") % 13 != 0, F.concat(F.lit("user"), F.col("user_id").cast("string"))).alias("username"),
                    F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("u"), ((F.col("user_id") + F.when(F.col("event_id") % 3 == 0, F.col("event_id"))
                                           .otherwise(0)) % 100).cast("string"), F.lit("@example.com")))
                    .alias("email"))


def event_k() -> Column:
    """The integer ``k`` of an event's JSON props."""
    return F.get_json_object("props", "$.k").try_cast("bigint")
