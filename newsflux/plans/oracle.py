"""DuckDB SQL oracles, one per query in ``catalog.QUERIES`` where SQL can say it.

The SQL is written independently of the Spark plans (recursive CTE for the
pool fold, correlated subqueries, list lambdas); only the fixed values and
the recipes of derived inputs are shared.
"""

from __future__ import annotations

import json

from ..functions.text import WS_CLASS, named_references
from ..functions.urls import DENY_PAGES, denied_host
from ..operators.extract import INDUSTRY_REPORT_WORD, STOCK_REPORT_WORD
from ..operators.profiles import CHANGE_LABEL, PRICE_LABEL
from ..sources.derived import REFERENCES

WS = WS_CLASS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def multi_space(x: str) -> str:
    return f"regexp_replace(replace({x}, chr(160), ' '), '{WS}{{2,}}', ' ', 'g')"


def clean(x: str) -> str:
    return strip(multi_space(x))


# character references: split at ampersands, decode what each piece begins with
_REFS = f"{q(json.dumps(named_references(), ensure_ascii=False))}::JSON::MAP(VARCHAR, VARCHAR)"
_REF = "regexp_extract(p, '^(#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});', 1)"


def unescape(x: str) -> str:
    code = (f"(CASE WHEN lower(substr({_REF}, 1, 2)) = '#x' THEN TRY_CAST('0x' || substr({_REF}, 3) AS INTEGER) "
            f"ELSE TRY_CAST(substr({_REF}, 2) AS INTEGER) END)")
    char = (f"(CASE WHEN {_REF} = '' THEN NULL WHEN {_REF} NOT LIKE '#%' THEN ({_REFS})[{_REF}] "
            f"WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111 THEN chr({code}) END)")
    piece = f"(CASE WHEN {char} IS NOT NULL THEN {char} || substr(p, length({_REF}) + 2) ELSE '&' || p END)"
    return (f"(CASE WHEN NOT contains({x}, '&') THEN {x} ELSE string_split({x}, '&')[1] || array_to_string("
            f"list_transform(string_split({x}, '&')[2:], lambda p: {piece}), '') END)")


def html_text(x: str) -> str:
    return clean(unescape(f"regexp_replace({x}, '<[^>]*>', '', 'g')"))


def comparable(x: str) -> str:
    host = f"regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)"
    return (f"NOT (regexp_matches({host}, {q(denied_host())}) OR "
            + " OR ".join(f"contains({x}, {q(s)})" for s in DENY_PAGES) + ")")


def ts_str(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


def day_str(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def minute_str(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M')"


def split_ws(x: str) -> str:
    s = strip(x)
    return f"(CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE regexp_split_to_array({s}, '{WS}+') END)"


TITLE = ("COALESCE(NULLIF(" + html_text("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)") + ", ''), "
         "NULLIF(" + html_text("regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)") + ", ''))")
HAS_ARTICLE = r"regexp_matches(html, '<article[\s>]')"
INNER = r"regexp_extract(html, '(?s)<article[^>]*>(.*?)(?:</article>|$)', 1)"
BLOCKS = (f"CASE WHEN {HAS_ARTICLE} THEN list_filter(list_transform("
          rf"regexp_split_to_array({INNER}, '<p(?:\s[^>]*)?>')[2:], "
          "lambda x: " + html_text("split_part(x, '</p>', 1)") + "), lambda x: length(x) > 0) END")

CRAWL = """
ev AS (
  SELECT event_id, ts, user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS run_start,
         event_id % (SELECT count(*) FROM pages) AS page_id
  FROM events)"""

POOL_CTES = f"""
WITH RECURSIVE {CRAWL.strip()},
arts AS (
  SELECT page_id, url, {TITLE} AS title FROM pages
  WHERE {HAS_ARTICLE} AND {comparable('url')}),
cr AS (SELECT ev.event_id, ev.ts, ev.run_start, a.url FROM ev JOIN arts a USING (page_id)),
firsts AS (
  SELECT url, run_start, ts, event_id,
         row_number() OVER (PARTITION BY url ORDER BY run_start) AS k
  FROM (SELECT *, row_number() OVER (PARTITION BY url, run_start ORDER BY ts, event_id) AS rn FROM cr)
  WHERE rn = 1),
fold(url, k, run_start, ts, event_id, last_adm, admitted) AS (
  SELECT url, k, run_start, ts, event_id, ts, TRUE FROM firsts WHERE k = 1
  UNION ALL
  SELECT f.url, f.k, f.run_start, f.ts, f.event_id,
         CASE WHEN p.last_adm < f.run_start - INTERVAL 5 DAY THEN f.ts ELSE p.last_adm END,
         p.last_adm < f.run_start - INTERVAL 5 DAY
  FROM fold p JOIN firsts f ON f.url = p.url AND f.k = p.k + 1),
adm AS (SELECT url, run_start, ts AS db_time, event_id FROM fold WHERE admitted),
last_run AS (SELECT max(run_start) AS t FROM ev JOIN pages USING (page_id)),
pool AS (
  SELECT a.url, a.db_time, arts.title, {minute_str('a.db_time')} AS pb_time
  FROM (SELECT url, max(db_time) AS db_time FROM adm GROUP BY url) a
  JOIN arts USING (url)
  WHERE a.db_time >= (SELECT t FROM last_run) - INTERVAL 5 DAY)
"""

ORACLE: dict[str, str] = {}

ORACLE["candidate_admissions"] = POOL_CTES + f"""
SELECT url, {day_str('run_start')} AS run_day, {ts_str('db_time')} AS db_time, event_id FROM adm"""

ORACLE["candidate_pool_asof"] = POOL_CTES + f"""
SELECT url, title, pb_time, {ts_str('db_time')} AS db_time FROM pool"""

ORACLE["latest_candidates"] = POOL_CTES + """
SELECT CAST(row_number() OVER (ORDER BY pb_time DESC NULLS LAST, url) - 1 AS BIGINT) AS rank,
       title, pb_time, url
FROM pool ORDER BY pb_time DESC NULLS LAST, url LIMIT 10"""

ORACLE["candidate_expired_count"] = POOL_CTES + f"""
, runs AS (SELECT DISTINCT run_start FROM ev JOIN pages USING (page_id)),
gone AS (
  SELECT (SELECT min(r.run_start) FROM runs r WHERE r.run_start > a.db_time + INTERVAL 5 DAY) AS gone_at
  FROM adm a)
SELECT {day_str('gone_at')} AS run_day, CAST(count(*) AS BIGINT) AS n_expired
FROM gone WHERE gone_at IS NOT NULL GROUP BY gone_at"""

ORACLE["page_titles"] = f"SELECT page_id, {TITLE} AS title FROM pages"

ORACLE["page_blocks"] = f"""
SELECT page_id, CAST(i - 1 AS BIGINT) AS ord, b[i] AS text
FROM (SELECT page_id, {BLOCKS} AS b FROM pages) , generate_series(1, len(b)) AS g(i)"""

_ORIGIN = r"regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
# a URL's parts, and a path without dot segments: a fold over its segments
_PART = r"regexp_extract({0}, '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$', {1})"


def without_dots(p: str) -> str:
    return f"""(CASE WHEN starts_with({p}, '/') THEN list_reduce(
      list_concat([''], string_split(substr({p} || CASE WHEN regexp_matches({p}, '/\\.\\.?$') THEN '/' ELSE '' END, 2), '/')),
      lambda done, s: CASE s WHEN '..' THEN regexp_replace(done, '/[^/]*$', '') WHEN '.' THEN done ELSE done || '/' || s END) ELSE {p} END)"""


def resolved(ref: str, url: str) -> str:
    """Reference resolution of RFC 3986 for absolute page URLs."""
    r = [_PART.format(ref, i) for i in range(6)]
    u = [_PART.format(url, i) for i in range(6)]
    site = f"({u[1]} || ':' || {u[2]})"
    joined = f"(CASE WHEN {u[3]} = '' THEN '/' || {r[3]} ELSE regexp_extract({u[3]}, '^(.*/)', 1) || {r[3]} END)"
    return f"""(CASE WHEN {r[1]} <> '' THEN {r[1]} || ':' || {r[2]} || {without_dots(r[3])} || {r[4]} || {r[5]}
      WHEN {r[2]} <> '' THEN {u[1]} || ':' || {r[2]} || {without_dots(r[3])} || {r[4]} || {r[5]}
      WHEN {r[3]} = '' THEN {site} || {u[3]} || (CASE WHEN {r[4]} <> '' THEN {r[4]} ELSE {u[4]} END) || {r[5]}
      WHEN starts_with({r[3]}, '/') THEN {site} || {without_dots(r[3])} || {r[4]} || {r[5]}
      ELSE {site} || {without_dots(joined)} || {r[4]} || {r[5]} END)"""


HREFS = ("list_transform(regexp_extract_all(html, '<a\\s(?:[^>\"'']|\"[^\"]*\"|''[^'']*'')*?\\bhref\\s*=\\s*(\"[^\"]*\"|''[^'']*''"
         "|[^\\s>\"'']+)', 1, 'i'), lambda v: " + unescape("regexp_replace(v, '^[\"'']|[\"'']$', '', 'g')") + ")")
ORACLE["page_links"] = rf"""
SELECT page_id, CAST(i - 1 AS BIGINT) AS pos, h[i] AS href, {resolved('h[i]', 'url')} AS abs_url
FROM (SELECT page_id, url, {HREFS} AS h FROM pages),
     generate_series(1, len(h)) AS g(i)"""

ORACLE["relative_links"] = f"""
SELECT page_id, ref, {resolved('ref', 'url')} AS abs_url
FROM pages, (SELECT unnest([{', '.join(q(r) for r in REFERENCES)}]) AS ref)"""

ORACLE["final_urls"] = """
WITH p AS (SELECT page_id AS k, page_id // 7 AS chain, url FROM pages),
ends AS (SELECT chain, max(k) AS last, max_by(url, k) AS url FROM p GROUP BY chain)
SELECT k AS page_id, 'http://r.example/' || k AS requested,
       CASE WHEN last % 7 <> 6 THEN 'http://r.example/' || (last + 1) WHEN chain % 10 = 3 THEN NULL ELSE e.url END AS final_url,
       last % 7 = 6 AND chain % 10 = 3 AS looped
FROM p JOIN ends e USING (chain)"""

ORACLE["url_denylist"] = f"SELECT page_id, url, {comparable('url')} AS followed FROM pages"

_HOST = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)"
_PREFIX = f"(CASE WHEN len(string_split({_HOST}, '.')) > 3 THEN split_part({_HOST}, '.', 1) ELSE '' END)"
ORACLE["access_class"] = rf"""
SELECT page_id, access,
       CASE WHEN access = 'premium'
            THEN {_ORIGIN} || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)
            ELSE url END AS item_url,
       (access = 'free' AND b IS NOT NULL) AS stored,
       CAST(CASE WHEN access = 'free' AND b IS NOT NULL THEN len(b) ELSE -1 END AS BIGINT) AS n_blocks
FROM (SELECT page_id, url, {BLOCKS} AS b,
             CASE {_PREFIX} WHEN 'blog' THEN 'external' WHEN 'm' THEN 'premium' ELSE 'free' END AS access
      FROM pages WHERE contains(url, '.example.'))"""

ORACLE["first_write_articles"] = """
SELECT md5(text) AS text_key, doc_id, source, lang, CAST(0 AS BIGINT) AS reads, CAST(0 AS BIGINT) AS n_liked
FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents)
WHERE rn = 1"""

ORACLE["route_sources"] = """
SELECT doc_id, source,
       CASE WHEN n IS NULL OR n > 18 THEN 'quarantine' ELSE
         ['wallstreet', 'hexun', 'sina', 'sina_roll', 'tencent', 'em_articles', 'announcements',
          'research_reports', 'stocks', 'holders'][n % 10 + 1] END AS target,
       CASE WHEN n IS NULL OR n > 18 THEN 'no route' END AS reason
FROM (SELECT *, TRY_CAST(regexp_extract(source, '^src([0-9]+)$', 1) AS INTEGER) AS n FROM documents)"""

ORACLE["clean_text"] = f"""
SELECT doc_id, {clean('text')} AS clean, replace({clean('text')}, chr(10), ' ') AS flat,
       CAST(length(replace(text, chr(160), '')) AS BIGINT) AS n_chars_no_nbsp,
       CAST(len({split_ws('text')}) AS BIGINT) AS n_tokens
FROM (SELECT doc_id, chr(160) || ' ' || replace(replace(text, '. ', '.' || chr(160) || chr(160)), ', ', ',' || chr(160))
             || ' ' || chr(9) AS text FROM documents)"""

ORACLE["br_lines"] = f"""
SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, l[i] AS line
FROM (SELECT doc_id, string_split({strip('text')}, chr(10)) AS l FROM documents), generate_series(1, len(l)) AS g(i)"""


# --- phase 3/4 ----------------------------------------------------------------

def code(k: str) -> str:
    k = f"({k})"
    return (f"((CASE WHEN {k} % 2 = 1 THEN 'sh' ELSE 'sz' END) || CAST({k} % 7 AS VARCHAR) || "
            f"to_base({k} % 60466176, 36, 5))")


LINES = f"""
lines AS (
  SELECT p_partkey AS line_no,
         CASE WHEN p_partkey % 50 = 0 THEN {code('p_partkey')} || ':' || p_name || ':' || p_brand
              WHEN p_partkey % 70 = 0 THEN ' ' || {code('p_partkey - 1')} || ' : ' || p_name || ' '
              ELSE {code('p_partkey')} || ':' || p_name END AS line
  FROM part),
stocks AS (
  SELECT code, arg_max(name, line_no) AS name
  FROM (SELECT line_no, {strip('p[1]')} AS code, {strip('p[2]')} AS name
        FROM (SELECT line_no, string_split({strip('line')}, ':') AS p FROM lines) WHERE len(p) = 2)
  GROUP BY code),
stock_names AS (SELECT name, min(code) AS code FROM stocks GROUP BY name)"""

ORACLE["code_table"] = f"WITH {LINES.strip()}\nSELECT code, name FROM stocks"

ORACLE["asset_class"] = f"""WITH {LINES.strip()}
SELECT code, 'http://quote.example.com/' || code || '.html' AS quote_url,
       CASE substr(code, 3, 1) WHEN '2' THEN 'bond' WHEN '5' THEN 'fund' ELSE 'stock' END AS asset
FROM stocks"""

ORACLE["code_from_url"] = rf"""
WITH links AS (
  SELECT p_partkey AS line_no,
         CASE WHEN p_partkey % 40 = 0 THEN 'http://quote.example.com/list' || CAST(p_partkey AS VARCHAR) || '.html'
              ELSE 'http://quote.example.com/' || {code('p_partkey')} || '.html' END AS href,
         CASE WHEN p_partkey % 30 = 0 THEN p_name ELSE p_name || '(' || {code('p_partkey')} || ')' END AS label
  FROM part),
c AS (SELECT *, regexp_extract(href, '^(?:.*/)?([^/]*)\.html', 1) AS code FROM links)
SELECT line_no, substr(code, 1, 2) AS market, substr(code, 3, 6) AS stock_id,
       CASE WHEN contains(label, '(') THEN regexp_extract(label, '^(.*)\(', 1) ELSE label END AS stock_name,
       substr(href, length(href) - 10, 6) AS id6
FROM c WHERE length(code) = 8"""

PROBES = f"""
probes AS (
  SELECT l_orderkey, l_linenumber,
         CASE l_linenumber % 3 WHEN 0 THEN {code('l_partkey')} WHEN 1 THEN p_name
              ELSE 'szx' || CAST(l_partkey AS VARCHAR) END AS q
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

ORACLE["stock_lookup"] = f"""WITH {LINES.strip()}, {PROBES.strip()}
SELECT l_orderkey, l_linenumber, q, s.code FROM probes JOIN stocks s ON s.code = q
WHERE starts_with(q, 'sz') OR starts_with(q, 'sh')
UNION ALL
SELECT l_orderkey, l_linenumber, q, n.code FROM probes JOIN stock_names n ON n.name = q
WHERE NOT (starts_with(q, 'sz') OR starts_with(q, 'sh'))"""

ORACLE["stock_insert_if_absent"] = f"""
WITH d AS (
  SELECT {code('l_partkey')} AS code, l_orderkey, l_linenumber, l_shipdate,
         row_number() OVER (PARTITION BY {code('l_partkey')} ORDER BY l_shipdate, l_orderkey, l_linenumber) AS rn
  FROM lineitem)
SELECT code, l_orderkey, l_linenumber, strftime(l_shipdate, '%Y%m%d:%H') AS stock_insert_time
FROM d WHERE rn = 1 AND code NOT IN (SELECT {code('p_partkey')} FROM part WHERE p_size <= 25)"""

WATCH = f"""
adds AS (
  SELECT o_custkey AS user_id, {code('l_partkey')} AS code, o_orderdate + to_minutes(l_linenumber) AS added_at,
         l_orderkey, l_linenumber
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
wl AS (
  SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY added_at, l_orderkey, l_linenumber, code) AS BIGINT) AS pos, code
  FROM adds)"""

ORACLE["watchlist_named"] = f"""WITH {LINES.strip()}, {WATCH.strip()}
SELECT user_id, pos, wl.code, s.name FROM wl LEFT JOIN stocks s USING (code)"""


def cents_str(c: str) -> str:
    return f"(CAST({c} // 100 AS VARCHAR) || '.' || lpad(CAST({c} % 100 AS VARCHAR), 2, '0'))"


ORACLE["watchlist_quotes"] = f"""WITH {WATCH.strip()},
pc AS (SELECT p_partkey AS k, p_name, CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) AS c FROM part),
ql AS (
  SELECT {code('k')} AS code,
         'var hq_str_' || {code('k')} || '="' || p_name || ',' || {cents_str('c')} || ',' ||
         {cents_str('(CASE WHEN k % 13 = 0 THEN 0 ELSE c * 98 // 100 END)')} || ',' ||
         {cents_str('(c * (100 + k % 11 - 5) // 100)')} || ',0,0,2024-01-02,15:00:00";' AS payload
  FROM pc),
qp AS (
  SELECT code, string_split(payload, ',') AS d FROM ql),
quotes AS (
  SELECT code, substr(d[1], strpos(d[1], '"') + 1) AS name,
         TRY_CAST(d[4] AS DOUBLE) AS cur, TRY_CAST(d[3] AS DOUBLE) AS prev FROM qp),
q2 AS (
  SELECT code, name, cur, cur - prev AS delta,
         CASE WHEN prev > 0 THEN 100.0 * (cur - prev) / prev ELSE 0.0 END AS pct FROM quotes)
SELECT user_id, pos, code,
       CAST(pos AS VARCHAR) || '. ' || name || chr(10) || {q(PRICE_LABEL)} || printf('%.2f', cur) ||
       chr(9) || {q(CHANGE_LABEL)} || printf('%+.2f', delta) || ' (' || printf('%+.2f', pct) || ')%' AS report
FROM wl JOIN q2 USING (code)"""

ATTRS = """
attrs AS (
  SELECT s_suppkey, s_name AS name,
         CASE WHEN s_nationkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex,
         CAST(30 + s_suppkey % 35 AS VARCHAR) AS age,
         CASE s_nationkey % 3 WHEN 0 THEN 'PhD' WHEN 1 THEN 'MBA' ELSE 'BSc' END AS edu,
         CASE WHEN s_acctbal > 0 THEN 'director' ELSE 'manager' END AS duty,
         strftime(DATE '2010-01-01' + CAST(s_suppkey % 3000 AS INTEGER), '%Y-%m-%d') AS start_time,
         'nation ' || CAST(s_nationkey AS VARCHAR) AS intro
  FROM supplier),
ids AS (SELECT *, substr(md5(concat_ws(chr(1), name, sex, age, edu)), 1, 16) AS userid FROM attrs)"""

PAIRS = f"""{ATTRS.strip()},
pairs AS (
  SELECT ids.*, {code('l_partkey')} AS stock_id, l_orderkey, l_linenumber,
         l_shipdate < TIMESTAMP '1995-01-01' AS in_base
  FROM lineitem JOIN ids ON l_suppkey = s_suppkey)"""

ORACLE["holder_upsert"] = f"""WITH {PAIRS},
o AS (
  SELECT *, row_number() OVER (PARTITION BY userid ORDER BY (NOT in_base), l_orderkey, l_linenumber, stock_id) AS rn,
         count(*) OVER (PARTITION BY userid) AS n
  FROM pairs)
SELECT f.userid, f.name, f.sex, f.age, f.edu, f.duty, CAST(f.n AS BIGINT) AS n_stocks,
       f.stock_id AS first_stock, l.stock_id AS last_stock
FROM o f JOIN o l ON f.userid = l.userid AND f.rn = 1 AND l.rn = l.n"""

ORACLE["holder_stock_list"] = f"""WITH {PAIRS}
SELECT userid, CAST(row_number() OVER (PARTITION BY userid ORDER BY (NOT in_base), l_orderkey, l_linenumber, stock_id) AS BIGINT) AS pos,
       stock_id
FROM pairs"""

ORACLE["stock_holder_list"] = f"""WITH {PAIRS}
SELECT stock_id, CAST(row_number() OVER (PARTITION BY stock_id ORDER BY l_orderkey, l_linenumber, userid) AS BIGINT) AS pos, userid
FROM pairs"""

ORACLE["stock_holders"] = f"""WITH {PAIRS}
SELECT stock_id, CAST(count(*) AS BIGINT) AS n_holders,
       arg_min(userid, {{'a': l_orderkey, 'b': l_linenumber, 'c': userid}}) AS first_holder,
       arg_max(userid, {{'a': l_orderkey, 'b': l_linenumber, 'c': userid}}) AS last_holder
FROM pairs GROUP BY stock_id"""

ORACLE["holder_ids"] = f"WITH {ATTRS.strip()}\nSELECT s_suppkey, userid FROM ids"

ORACLE["manager_json"] = f"""WITH {ATTRS.strip()}
SELECT 'sh' || lpad(CAST(s_suppkey // 10 AS VARCHAR), 6, '0') AS stock_id,
       name, sex, age, edu, duty, start_time, intro, userid
FROM ids"""

ORACLE["comment_counts"] = """
SELECT event_id,
       coalesce(TRY_CAST(CASE WHEN event_type <> 'error' THEN json_extract_string(props, '$.k') END AS INTEGER), -1)
         AS commenters,
       coalesce(TRY_CAST(CASE WHEN event_type = 'signup' THEN 'n/a'
                              ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS INTEGER), -1)
         AS participants
FROM events"""

ORACLE["feed_minutes"] = """
SELECT 'https://feed.example.com/a/' || CAST(event_id AS VARCHAR) AS url,
       concat_ws(' ', event_type, CAST(user_id AS VARCHAR)) AS title,
       strftime(ts, '%Y-%m-%d %H:%M') AS pb_time,
       strftime(date_trunc('minute', ts) - INTERVAL 5 DAY, '%Y%m%d:%H') AS horizon_hour
FROM events"""

# the log replayed row by row, with the names and emails taken so far
SIGNUPS = """
su AS (
  SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN 'user' || CAST(user_id AS VARCHAR) END AS username,
         CASE WHEN event_id % 11 <> 0 THEN
           'u' || CAST((user_id + CASE WHEN event_id % 3 = 0 THEN event_id ELSE 0 END) % 100 AS VARCHAR) || '@example.com'
           END AS email,
         row_number() OVER (ORDER BY ts, event_id) AS i
  FROM events WHERE event_type = 'signup'),
replay(i, code, users, mails) AS (
  SELECT CAST(0 AS BIGINT), 0, []::VARCHAR[], []::VARCHAR[]
  UNION ALL
  SELECT su.i, CASE WHEN list_contains(users, u) THEN -3 WHEN list_contains(mails, m) THEN -4 ELSE 1 END,
         CASE WHEN list_contains(users, u) OR list_contains(mails, m) THEN users ELSE list_append(users, u) END,
         CASE WHEN list_contains(users, u) OR list_contains(mails, m) THEN mails ELSE list_append(mails, m) END
  FROM replay r JOIN (SELECT *, coalesce(username, '(none)') AS u, coalesce(email, '(none)') AS m FROM su) su ON su.i = r.i + 1),
reg AS (SELECT su.*, CAST(code AS INTEGER) AS code FROM su JOIN replay USING (i)),
profiles AS (SELECT username, email FROM reg WHERE code = 1),
del_keys AS (SELECT 'user' || CAST(c_custkey AS VARCHAR) AS username FROM customer WHERE c_mktsegment = 'BUILDING')"""

ORACLE["register_users"] = f"WITH RECURSIVE {SIGNUPS.strip()}\nSELECT event_id, username, email, code FROM reg"

ORACLE["delete_users"] = f"""WITH RECURSIVE {SIGNUPS.strip()}
SELECT username, email FROM profiles WHERE coalesce(username, '') NOT IN (SELECT username FROM del_keys)"""

ORACLE["deleted_count"] = f"""WITH RECURSIVE {SIGNUPS.strip()}
SELECT CAST(count(*) AS BIGINT) AS n_deleted FROM profiles WHERE username IN (SELECT username FROM del_keys)"""

ORACLE["keyed_merges"] = """
SELECT c_custkey AS k, c_name AS name,
       CASE WHEN c_acctbal > 9000 AND (c_custkey % 2 = 0 OR c_custkey % 3 = 0) THEN 'PRIVATE' ELSE c_mktsegment END AS segment,
       CASE WHEN c_custkey % 5 = 0 THEN 'upsert' WHEN c_custkey % 2 = 0 THEN 'base' ELSE 'insert' END AS source
FROM customer WHERE (c_custkey % 2 = 0 OR c_custkey % 3 = 0 OR c_custkey % 5 = 0) AND c_custkey % 7 <> 0"""

ORACLE["append_only"] = """
SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY event_type"""

ORACLE["update_profile"] = f"""WITH RECURSIVE {SIGNUPS.strip()},
d AS (SELECT 'user' || CAST(c_custkey AS VARCHAR) AS username,
             lower(replace(c_name, '#', '.')) || '@example.org' AS email
      FROM customer WHERE c_acctbal > 5000)
SELECT p.username, coalesce(d.email, p.email) AS email FROM profiles p LEFT JOIN d USING (username)"""

ORACLE["recent_reads"] = f"""
WITH {CRAWL.strip()},
r AS (
  SELECT ev.user_id, ev.event_id, p.url, {TITLE} AS title,
         row_number() OVER (PARTITION BY ev.user_id ORDER BY ev.ts DESC, ev.event_id DESC) AS rn
  FROM ev JOIN pages p USING (page_id))
SELECT user_id, CAST(rn AS BIGINT) AS pos, event_id, url, title FROM r WHERE rn <= 50"""

TAGEV = """
te AS (SELECT event_id, ts, user_id, event_type,
              TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""

ORACLE["tag_sets"] = f"""WITH {TAGEV.strip()},
s AS (SELECT user_id, list_sort(list_distinct(list(concat_ws('-', event_type, CAST(k % 5 AS VARCHAR))))) AS l
      FROM te GROUP BY user_id)
SELECT user_id, array_to_string(l, ',') AS tags, CAST(len(l) AS BIGINT) AS n_tags FROM s"""

ORACLE["tag_replay"] = f"""WITH {TAGEV.strip()},
a AS (SELECT user_id, 't' || CAST(k % 7 AS VARCHAR) AS tag, ts, event_id,
             CASE WHEN event_type = 'error' THEN 'del' ELSE 'add' END AS action
      FROM te WHERE event_type <> 'signup'),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id, tag ORDER BY ts DESC, event_id DESC) AS rn FROM a)
SELECT user_id, array_to_string(list_sort(list(tag)), ',') AS tags
FROM l WHERE rn = 1 AND action = 'add' GROUP BY user_id"""

ORACLE["delete_by_position"] = f"""WITH {TAGEV.strip()},
s AS (SELECT user_id, list_sort(list_distinct(list(concat_ws('-', event_type, CAST(k % 5 AS VARCHAR))))) AS l
      FROM te GROUP BY user_id),
d AS (SELECT user_id,
             CASE WHEN user_id % 5 < 1 OR user_id % 5 > len(l) THEN l
                  ELSE list_concat(l[1:user_id % 5 - 1], l[user_id % 5 + 1:]) END AS l
      FROM s)
SELECT user_id, array_to_string(l, ',') AS tags, CAST(len(l) AS BIGINT) AS n_tags FROM d"""

ORACLE["watchlist_replay"] = f"""WITH {LINES.strip()}, {TAGEV.strip()},
acts AS (
  SELECT user_id, ts, event_id, event_type,
         CASE WHEN event_type = 'view' THEN p_name ELSE {code('k')} END AS q
  FROM te LEFT JOIN part ON k = p_partkey
  WHERE event_type IN ('purchase', 'view', 'error')),
adds AS (
  SELECT a.user_id, a.ts, a.event_id, s.code FROM acts a JOIN stocks s ON s.code = a.q
  WHERE a.event_type <> 'error' AND (starts_with(a.q, 'sz') OR starts_with(a.q, 'sh'))
  UNION ALL
  SELECT a.user_id, a.ts, a.event_id, n.code FROM acts a JOIN stock_names n ON n.name = a.q
  WHERE a.event_type <> 'error' AND NOT (starts_with(a.q, 'sz') OR starts_with(a.q, 'sh'))),
dels AS (SELECT user_id, q AS code, max({{'ts': ts, 'id': event_id}}) AS last_del FROM acts WHERE event_type = 'error'
         GROUP BY ALL),
kept AS (
  SELECT adds.* FROM adds LEFT JOIN dels USING (user_id, code)
  WHERE dels.last_del IS NULL OR {{'ts': adds.ts, 'id': adds.event_id}} > dels.last_del)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id, code) AS BIGINT) AS pos, code
FROM kept"""


# --- phase 6 --------------------------------------------------------------------

def segment(x: str) -> str:
    return f"array_to_string({split_ws(x)}, ' ')"


CORPUS = f"""
art AS (
  SELECT CASE WHEN source IN ('src0', 'src10') THEN 'wallstreet' WHEN source IN ('src1', 'src11') THEN 'hexun'
              WHEN source IN ('src3', 'src13') THEN 'sina_roll' ELSE 'tencent' END AS source,
         CAST(doc_id AS VARCHAR) AS doc_key, string_split(text, chr(10))[1] AS title, string_split(text, chr(10))[2:] AS paras
  FROM documents WHERE source IN ('src0', 'src1', 'src3', 'src4', 'src10', 'src11', 'src13', 'src14')
  UNION ALL
  SELECT 'pages', CAST(page_id AS VARCHAR), {TITLE}, {BLOCKS} FROM pages
  UNION ALL
  SELECT 'benchmark', CAST(item_id AS VARCHAR), NULL, string_split(text, chr(10)) FROM benchmark
  UNION ALL
  SELECT 'conversations', concat_ws('-', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR)), NULL, string_split(text, chr(10)) FROM conversations),
ll AS (
  SELECT source, doc_key,
         list_concat(CASE WHEN length(title) > 0 THEN [title] ELSE []::VARCHAR[] END,
                     list_filter(coalesce(paras, []::VARCHAR[]), lambda p: NOT contains(p, '//'))) AS l
  FROM art),
lines AS (
  SELECT source, doc_key, CAST(i - 1 AS BIGINT) AS line_no, {segment('l[i]')} AS line
  FROM ll, generate_series(1, len(l)) AS g(i))"""

ORACLE["corpus_lines"] = f"WITH {CORPUS.strip()}\nSELECT source, doc_key, line_no, line FROM lines"

ORACLE["vocabulary"] = f"""WITH {CORPUS.strip()}
SELECT word, CAST(count(*) AS BIGINT) AS n
FROM (SELECT unnest({split_ws('line')}) AS word FROM lines)
GROUP BY word HAVING count(*) >= 5"""

ORACLE["word_vectors"] = f"""WITH {CORPUS.strip()}
SELECT word, CAST(128 AS BIGINT) AS dim
FROM (SELECT unnest({split_ws('line')}) AS word FROM lines)
GROUP BY word HAVING count(*) >= 5"""

ORACLE["corpus_mixed"] = rf"""
WITH pg AS (
  SELECT page_id, url, coalesce({BLOCKS}, []::VARCHAR[]) AS b,
         {HREFS} AS h
  FROM pages),
pieces AS (
  SELECT page_id, CAST(i - 1 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS sub, b[i] AS piece
  FROM pg, generate_series(1, len(b)) AS g(i)
  UNION ALL
  SELECT page_id, CAST(len(b) + j - 1 AS BIGINT), CAST(0 AS BIGINT), h[j]
  FROM pg, generate_series(1, len(h)) AS g(j)
  UNION ALL
  SELECT page_id, CAST(len(b) + j - 1 AS BIGINT), CAST(1 AS BIGINT),
         {resolved('h[j]', 'url')}
  FROM pg, generate_series(1, len(h)) AS g(j))
SELECT page_id, pos, sub, piece FROM pieces WHERE NOT contains(piece, '//')"""

ORACLE["word_lookup"] = """
WITH p AS (
  SELECT event_id, 'w' || CAST(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) * 7 + user_id AS VARCHAR) AS word
  FROM events),
e AS (SELECT 'w' || CAST(vec_id AS VARCHAR) AS word, embedding FROM embeddings)
SELECT p.event_id, p.word, e.embedding IS NOT NULL AS found,
       CAST(coalesce(len(e.embedding), (SELECT max(len(embedding)) FROM embeddings)) AS BIGINT) AS dim,
       CAST(coalesce(e.embedding[1], 0) AS DOUBLE) AS v_first,
       CAST(coalesce(e.embedding[len(e.embedding)], 0) AS DOUBLE) AS v_last,
       coalesce(list_sum(list_transform(e.embedding, lambda v, i: CAST(v AS DOUBLE) * i)), 0) AS v_sum
FROM p LEFT JOIN e USING (word)"""

ORACLE["stream_articles"] = ORACLE["first_write_articles"]
ORACLE["stream_pool"] = ORACLE["candidate_admissions"]
ORACLE["stream_reads"] = ORACLE["recent_reads"]


# --- phase 5 --------------------------------------------------------------------

_HEAD_TS = "(o_orderdate + to_seconds(o_orderkey % 86400))"
_HEAD = f"""
h AS (
  SELECT o_orderkey,
         concat_ws(' ', c_name, o_orderpriority || ' ', strftime({_HEAD_TS}, '%Y-%m-%d'),
                   strftime({_HEAD_TS}, '%H:%M:%S'),
                   c_mktsegment || CASE WHEN o_orderkey % 2 = 0 THEN ' clerk' || CAST(o_orderkey % 1000 AS VARCHAR) ELSE '' END
                                || CASE WHEN o_orderkey % 5 = 0 THEN ' wire' ELSE '' END) AS header
  FROM orders JOIN customer ON o_custkey = c_custkey),
t AS (SELECT o_orderkey, string_split({clean('header')}, ' ') AS tk FROM h),
k AS (
  SELECT o_orderkey, tk, len(tk) AS n,
         list_max(list_transform(tk[1:len(tk) - 1],
                  lambda x, i: CASE WHEN length(x) - length(replace(x, ':', '')) = 2 THEN i END)) AS kk
  FROM t),
p AS (SELECT o_orderkey, tk, n, CASE WHEN kk >= 2 THEN kk END AS k FROM k)"""

ORACLE["header_parse"] = f"""WITH {_HEAD.strip()}
SELECT o_orderkey,
       CASE WHEN k IS NOT NULL THEN array_to_string(tk[1:k - 2], '') END AS title,
       CASE WHEN k IS NOT NULL THEN tk[k - 1] || ' ' || tk[k] END AS pb_time,
       CASE WHEN k IS NULL THEN NULL WHEN len(tk[k + 1:]) = 2 THEN tk[k + 1] ELSE array_to_string(tk[k + 1:], ' ') END
         AS source,
       CASE WHEN k IS NULL THEN NULL WHEN len(tk[k + 1:]) = 2 THEN tk[k + 2] ELSE '' END AS author
FROM p"""

ORACLE["nav_links"] = r"""
WITH n AS (SELECT page_id, regexp_extract(html, '(?s)<nav[^>]*>(.*?)</nav>', 1) AS nav FROM pages),
li AS (SELECT page_id, string_split_regex(nav, '<li[\s>]')[2:] AS items FROM n),
x AS (SELECT page_id, i, regexp_extract(items[i], '<a\s[^>]*?href="([^"]*)"', 1) AS url
      FROM li, generate_series(1, len(items)) AS g(i))
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) AS BIGINT) AS pos, url
FROM x WHERE url <> '' AND NOT contains(url, 'index.html')"""
ORACLE["stream_profiles"] = ORACLE["tag_replay"]

ORACLE["feed_js"] = """
SELECT 'https://roll.example.com/a/' || CAST(event_id AS VARCHAR) AS url,
       concat_ws(' ', event_type, CAST(user_id AS VARCHAR)) AS title,
       strftime(ts, '%Y-%m-%d %H:%M') AS pb_time
FROM events"""

ORACLE["feed_bounded"] = """
SELECT (event_id // 50) % 9 + 1 AS page_no, CAST(event_id AS VARCHAR) AS url,
       concat_ws(' ', event_type, CAST(user_id AS VARCHAR)) AS title, strftime(ts, '%Y-%m-%d %H:%M') AS pb_time
FROM events WHERE (event_id // 50) % 9 < 5"""

ORACLE["feed_quarantine"] = """
SELECT kind, page, CAST(CASE WHEN page % 5 = k THEN 0 ELSE n END AS BIGINT) AS n_rows,
       CAST(CASE WHEN page % 5 = k THEN 1 ELSE 0 END AS BIGINT) AS n_bad
FROM (SELECT event_id // 50 AS page, count(*) AS n FROM events GROUP BY 1),
     (VALUES ('json', 0), ('js', 1), ('jsonp', 2), ('managers', 3)) AS f(kind, k)"""

ORACLE["feed_jsonp"] = """
SELECT 'http://news.example.com/新闻/' || CAST(event_id AS VARCHAR) AS url
FROM events WHERE event_type <> 'error'"""

# element counts by start tags outside comments, script and style bodies
ORACLE["page_nodes"] = r"""
WITH c AS (
  SELECT page_id,
         regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
                        '(?s)(<(script|style)[^>]*>).*?(</(script|style)>)', '\1\3', 'g') AS h
  FROM pages)
SELECT page_id, lower(tag) AS tag, count(*) AS n
FROM (SELECT page_id, unnest(regexp_extract_all(h, '<([A-Za-z][A-Za-z0-9]*)', 1)) AS tag FROM c)
GROUP BY ALL"""

ORACLE["article_paragraphs"] = ORACLE["page_blocks"]

ORACLE["ad_blocks"] = f"""
SELECT page_id, {html_text("regexp_extract(html, '(?s)<div class=" + '"ad"' + "[^>]*>(.*?)</div>', 1)")} AS ad_text
FROM pages WHERE regexp_matches(html, '<div class="ad"')"""


# --- site jobs: what the rules must take from the site-shaped pages -------------

K = "CAST(doc_id AS VARCHAR)"
M = "'¶'"
LINES_OF = "string_split(coalesce(text, ''), chr(10))"


def blocks(*parts: str) -> str:
    return f"array_to_string(list_concat({', '.join(parts)}), {M})"


def flat(x: str) -> str:
    return f"replace({clean(x)}, chr(10), ' ')"


STRIPPED = f"list_transform({LINES_OF}, lambda x: {strip('x')})"
FILLED = f"list_filter({STRIPPED}, lambda x: length(x) > 0)"
CLEANED = f"list_filter(list_transform({LINES_OF}, lambda x: {clean('x')}), lambda x: length(x) > 0)"

ORACLE["site_wallstreet"] = f"""
SELECT 'Title ' || {K} AS title, 'About ' || lang || ' ' || {K} AS summary,
       CASE WHEN doc_id % 2 = 0 THEN source END AS source,
       'https://wallstreetcn.example.com/' || CASE WHEN doc_id % 5 = 3 THEN 'premium/' ELSE 'articles/' END || {K} AS url,
       CASE WHEN doc_id % 5 < 3 THEN '2024-01-02 10:00 #' || {K} END AS pb_time,
       CASE WHEN doc_id % 5 < 3 THEN {blocks(f"['Head ' || {K}]", STRIPPED, f"[{K} || '.png']")} END AS blocks
FROM documents WHERE doc_id % 5 = 3 OR (doc_id % 5 < 3 AND doc_id % 4 <> 3)"""

ORACLE["site_sina"] = f"""
SELECT doc_id AS page_id, CASE WHEN doc_id % 2 = 0 THEN 'link ' ELSE 'span ' END || source AS source,
       CASE WHEN doc_id % 3 = 0 THEN 'editor ' || {K} END AS author,
       CASE WHEN doc_id % 5 <> 0 THEN 'Main title ' ELSE 'Listing ' END || {K} AS title, lang AS category,
       {blocks(CLEANED, f"['http://img.example.com/' || {K} || '.jpg']")} AS blocks
FROM documents WHERE doc_id % 7 <> 0"""

ORACLE["site_tencent_list"] = """
SELECT p_partkey // 20 AS page_id, row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) AS pos,
       p_brand AS category, 'http://new.example.com/' || p_partkey AS url, p_name AS title
FROM part"""

ORACLE["site_tencent"] = f"""
SELECT doc_id AS page_id, ['LEFT', 'qq_article', 'qq_article', 'gallery', 'other'][doc_id % 5 + 1] AS layout,
       CASE doc_id % 5 WHEN 0 THEN 'Left ' || {K} WHEN 4 THEN NULL ELSE 'QQ ' || {K} END AS title,
       CASE doc_id % 5 WHEN 0 THEN CASE WHEN doc_id % 2 = 0 THEN '2024-01-04 08:00' ELSE '2024-01-03 09:00' END
                       WHEN 4 THEN NULL ELSE '2024-01-05' END AS pb_time,
       CASE doc_id % 5 WHEN 0 THEN CASE WHEN doc_id % 2 = 0 THEN source ELSE 'LY' END
                       WHEN 4 THEN NULL ELSE source END AS source,
       CASE WHEN doc_id % 5 IN (1, 2, 3) THEN 'author ' || {K} END AS author,
       CASE WHEN doc_id % 5 IN (1, 2, 3) THEN lang END AS category,
       CASE doc_id % 5
         WHEN 0 THEN {blocks(FILLED, f"[{K} || '.png']")}
         WHEN 1 THEN {blocks(FILLED, "[]::VARCHAR[]")}
         WHEN 2 THEN CASE WHEN doc_id % 2 = 0 THEN ''
                     ELSE array_to_string(string_split({strip("coalesce(text, '')")}, chr(10)), {M}) END
         WHEN 3 THEN {blocks(f"[{K} || '-1.jpg', 'caption 1', {K} || '-2.jpg']", STRIPPED, "['caption 3']")}
         ELSE '' END AS blocks
FROM documents"""

ORACLE["site_hexun"] = f"""
WITH h AS (SELECT *, list_transform({LINES_OF}, lambda x: {flat('x')}) AS l FROM documents WHERE doc_id % 6 <> 0)
SELECT doc_id AS page_id, source || {M} || lang AS cur_source, 'BigNews' || {K} AS title, '2024-01-02 10:11:12' AS pb_time,
       source, CASE WHEN doc_id % 2 = 0 THEN 'writer' ELSE '' END AS author,
       {blocks(f"['Lead ' || {K} || ' ', 'first §' || {K} || '§', 'Chart ' || {K} || '|b.png']", "l",
               f"['last §§' || {K} || '§§', CASE WHEN doc_id % 3 = 2 THEN '' ELSE 'tail words' END]",
               "CASE WHEN doc_id % 4 = 0 THEN ['after|c.png'] ELSE []::VARCHAR[] END")} AS blocks
FROM h"""

ORACLE["site_eastmoney"] = f"""
SELECT doc_id AS page_id, lang || {M} || source AS cur_source, '2024-01-06 07:00' AS pb_time,
       CASE WHEN doc_id % 2 = 0 THEN 'EM Source' ELSE source END AS source,
       CASE WHEN doc_id % 3 = 0 THEN 'writer ' || {K} ELSE '' END AS author,
       CASE WHEN doc_id % 4 <> 0 THEN 'ed ' || {K} ELSE '' END AS editor,
       CAST(CASE WHEN doc_id % 5 < 2 THEN -1 ELSE doc_id END AS INTEGER) AS commenters, CAST(doc_id * 2 AS INTEGER) AS participants,
       {M} || 'only §' || {K} || '§' || {M} || '|x.png' AS blocks
FROM documents"""

ORACLE["site_announcements"] = f"""
SELECT doc_id AS page_id, '2024-01-07 ' || {K} AS anno_time, 'http://pdf.example.com/' || {K} || '.pdf' AS source_pdf_url,
       coalesce(text, '') AS content
FROM documents"""

ORACLE["site_research"] = f"""
SELECT doc_id AS page_id, CASE WHEN doc_id % 2 = 0 THEN {q(STOCK_REPORT_WORD)} ELSE {q(INDUSTRY_REPORT_WORD)} END AS research_report_type,
       'Analyst ' || {K} AS author, CASE WHEN doc_id % 2 = 0 THEN 'k' || {K} || '.png' ELSE '' END AS img_k_url,
       CASE WHEN doc_id % 2 = 0 THEN 'K line ' || {K} ELSE '' END AS img_k_alt,
       CASE WHEN doc_id % 2 = 0 THEN {M} ELSE 'c1-' || {K} || '.png' || {M} || 'c2-' || {K} || '.png' END AS charts,
       array_to_string(['', 'one §' || {K} || '§', '|c.png', 'two §§' || {K} || '§§', ''], {M}) AS blocks
FROM documents"""

ORACLE["site_br_text"] = f"""
SELECT doc_id AS page_id, array_to_string({STRIPPED}, chr(10)) AS text FROM documents"""

ORACLE["site_stock_list"] = ORACLE["code_from_url"].replace("SELECT line_no, substr(code, 1, 2) AS market,", """
SELECT line_no // 50 AS page_id, row_number() OVER (PARTITION BY line_no // 50 ORDER BY line_no) AS pos,
       substr(code, 1, 2) AS stock_market,""").replace(""",
       substr(href, length(href) - 10, 6) AS id6""", "")

_QUOTE_ID = f"substr({code('p_partkey')}, 3, 6)"


def site_links(where: str, *kinds: tuple[str, str]) -> str:
    rows = [f"SELECT p_partkey, p_name, {i} AS i, {q(what)} AS what, {q(kind)} AS type FROM part WHERE {where}"
            for i, (what, kind) in enumerate(kinds)]
    return f"""WITH l AS ({' UNION ALL '.join(rows)})
SELECT p_partkey AS page_id, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS pos, {_QUOTE_ID} AS id,
       p_name || ' ' || what AS title, type, 'http://s.example.com/' || what || p_partkey AS href FROM l"""


ORACLE["site_funds"] = site_links("p_partkey % 4 <> 0", ("f1", "fund_news"), ("f2", "fund_news"))
ORACLE["site_bonds"] = site_links("true", ("n", "bond_news"), ("a", "bond_announce"))
ORACLE["site_stocks"] = site_links("true", ("news", "stock_news"), ("notice", "stock_trade_news"))
ORACLE["site_reports"] = f"""
WITH r AS (SELECT *, 0 AS i, 's' AS kind, {q(STOCK_REPORT_WORD)} AS type FROM part
           UNION ALL SELECT *, 1, 'i', {q(INDUSTRY_REPORT_WORD)} FROM part WHERE p_partkey % 3 <> 0)
SELECT p_partkey AS page_id, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS pos, p_type AS ji_gou, p_brand AS ping_ji,
       '01-02' AS time, p_name AS title, 'http://r.example.com/' || kind || p_partkey AS href, type FROM r"""


# --- unions, lookups, files ------------------------------------------------------

ORACLE["pool_union"] = f"""
WITH RECURSIVE src AS (
  SELECT event_id, ts, CAST(date_trunc('day', ts) AS TIMESTAMP) AS run_start, event_type AS source, url,
         CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_type || ' ' || event_id END AS title
  FROM events JOIN pages ON page_id = event_id % (SELECT count(*) FROM pages)
  WHERE {HAS_ARTICLE} AND event_type IN ('view', 'click', 'purchase', 'error', 'signup')),
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY run_start) AS k
  FROM (SELECT *, row_number() OVER (PARTITION BY url, run_start ORDER BY ts, event_id) AS rn FROM src) WHERE rn = 1),
fold(url, k, run_start, event_id, source, title, last_adm, admitted) AS (
  SELECT url, k, run_start, event_id, source, title, ts, TRUE FROM firsts WHERE k = 1
  UNION ALL
  SELECT f.url, f.k, f.run_start, f.event_id, f.source, f.title,
         CASE WHEN p.last_adm < f.run_start - INTERVAL 5 DAY THEN f.ts ELSE p.last_adm END,
         p.last_adm < f.run_start - INTERVAL 5 DAY
  FROM fold p JOIN firsts f ON f.url = p.url AND f.k = p.k + 1)
SELECT url, {day_str('run_start')} AS run_day, event_id, source, title FROM fold WHERE admitted"""

ORACLE["stream_two_sinks"] = f"""
WITH RECURSIVE a AS (
  SELECT event_id, ts, date_trunc('day', ts) AS run_start, url, {HAS_ARTICLE} AS has_body,
         CASE WHEN event_type <> 'error' THEN event_type || ' ' || event_id END AS title
  FROM events JOIN pages ON page_id = event_id % (SELECT count(*) FROM pages)),
store AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY url ORDER BY ts, event_id) = 1),
fit AS (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY run_start) AS k FROM (
    SELECT * FROM a WHERE has_body AND title IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY url, run_start ORDER BY ts, event_id) = 1)),
fold(url, k, event_id, title, last, admitted) AS (
  SELECT url, k, event_id, title, ts, true FROM fit WHERE k = 1
  UNION ALL
  SELECT f.url, f.k, f.event_id, f.title, CASE WHEN p.last < f.run_start - INTERVAL 5 DAY THEN f.ts ELSE p.last END,
         p.last < f.run_start - INTERVAL 5 DAY
  FROM fold p JOIN fit f ON f.url = p.url AND f.k = p.k + 1)
SELECT 'store' AS sink, event_id, url, title FROM store
UNION ALL SELECT 'candidates', event_id, url, title FROM fold WHERE admitted"""

ORACLE["profile_lookup"] = f"""WITH RECURSIVE {SIGNUPS.strip()}
SELECT 'user' || c_custkey AS username, email, p.username IS NOT NULL AS found
FROM customer LEFT JOIN profiles p ON p.username = 'user' || c_custkey"""

ORACLE["personal_topk"] = """
WITH items AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, (SELECT count(*) FROM embeddings) AS n FROM embeddings),
reads AS (
  SELECT user_id, event_id % (SELECT count(*) FROM embeddings) AS item_id FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50),
parts AS (
  SELECT user_id, d, sum(v[d]) AS x FROM reads JOIN items ON vec_id = item_id, generate_series(1, len(v)) AS g(d) GROUP BY ALL),
users AS (SELECT user_id, list(x ORDER BY d) AS u FROM parts GROUP BY user_id),
scored AS (
  SELECT user_id, vec_id AS item_id,
         round(list_dot_product(u, v) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v))), 9) AS score
  FROM users, items WHERE (user_id, vec_id) NOT IN (SELECT (user_id, item_id) FROM reads))
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS pos, item_id, CAST(round(score * 1e9) AS BIGINT) AS cosine_e9
FROM scored QUALIFY pos <= 10"""

ORACLE["segmented_lines"] = """
WITH lines AS (
  SELECT doc_id, i - 1 AS line_no, string_split(lower(text), chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)),
words AS (SELECT doc_id, line_no, regexp_extract_all(line, '[a-z]+') AS w FROM lines)
SELECT doc_id, line_no, array_to_string(list_transform(w, lambda x:
         translate(substr(x, 1, 1), {letters}, {initials}) || translate(substr(x, 2), {letters}, {inners})), ' ') AS words
FROM words WHERE len(w) > 0""".format(letters="'abcdefghijklmnopqrstuvwxyz'",
                                      initials="'" + "".join(chr(0x4E00 + i) for i in range(26)) + "'",
                                      inners="'" + "".join(chr(0x5200 + i) for i in range(26)) + "'")

ORACLE["parse_quarantine"] = """
SELECT 'feed' AS kind, CAST(event_id AS VARCHAR) AS record, 'invalid JSON' AS reason FROM events WHERE event_id % 50 = 7
UNION ALL
SELECT 'page', CAST(page_id AS VARCHAR), 'no paragraph container' FROM pages WHERE NOT contains(coalesce(html, ''), '<p>')"""

ORACLE["corpus_files"] = f"""WITH {CORPUS.strip()}
SELECT source, count(*) AS n_lines, CAST(sum(len({split_ws('line')})) AS BIGINT) AS n_tokens FROM lines GROUP BY source"""

ORACLE["saved_vectors"] = f"""
WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark)
SELECT word, CAST(128 AS BIGINT) AS dim, true AS same
FROM (SELECT unnest({split_ws('line')}) AS word FROM l WHERE NOT contains(line, '//'))
GROUP BY word HAVING count(*) >= 5"""

ORACLE["site_tencent_items"] = f"""
SELECT 'http://new.example.com/' || {K} AS url, ['LEFT', 'qq_article', 'qq_article', 'gallery', 'other'][doc_id % 5 + 1] AS layout,
       CASE doc_id % 5 WHEN 0 THEN 'Left ' WHEN 4 THEN 'Listed ' ELSE 'QQ ' END || {K} AS title,
       CASE WHEN doc_id % 5 IN (1, 2, 3) THEN lang ELSE 'cat ' || lang END AS category
FROM documents"""

ORACLE["site_report_items"] = f"""
SELECT 'http://r.example.com/s' || p_partkey AS url, p_name AS title, p_type AS ji_gou, p_brand AS ping_ji, '01-02' AS time,
       {q(STOCK_REPORT_WORD)} AS type, 'Analyst ' || p_partkey AS author, 'k' || p_partkey || '.png' AS img_k_url,
       {M} || 'one §' || p_partkey || '§ ' || p_brand AS blocks
FROM part"""

ORACLE["watchlist_delete_position"] = f"""WITH {WATCH.strip()}
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY pos) AS BIGINT) AS pos, code
FROM wl WHERE NOT (user_id % 5 >= 1 AND pos = user_id % 5)"""

ORACLE["stream_stocks"] = f"""WITH {TAGEV.strip()},
a AS (SELECT user_id, {code('k % 50')} AS code, ts, event_id, event_type FROM te WHERE event_type IN ('purchase', 'error')),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id, code ORDER BY ts DESC, event_id DESC) AS rn FROM a)
SELECT user_id, array_to_string(list_sort(list(code)), ',') AS codes
FROM l WHERE rn = 1 AND event_type = 'purchase' GROUP BY user_id"""
