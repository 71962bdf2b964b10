"""Landed payloads -> rows.

Each function takes a DataFrame with a payload column and returns rows; the
parsing is ``from_json`` / ``split`` / ``regexp_extract`` inside the JVM.

K11: a payload that cannot be read (cut short, of another shape, NULL) gives no
rows. Parsers that are given a column name as ``bad`` return it too, from the same
scan: one row with that column holding the payload and all fields NULL. ``split_bad``
parts the two kinds of rows and ``watch`` counts them on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T

# {"result": {"data": [{"url", "title", "mtime"}]}}
JSON_FEED_SCHEMA = "struct<result:struct<data:array<struct<url:string,title:string,mtime:string>>>>"
# Var x = {list: [{title: '..', time: 1700000000, url: '..'}]};
JS_FEED_SCHEMA = "struct<list:array<struct<title:string,time:bigint,url:string>>>"
# S3: cb({"result": [{"entityurl": ".."}]})
JSONP_FEED_SCHEMA = "struct<result:array<struct<entityurl:string>>>"
# {"Result": {"RptManagerList": [{xm, xb, nl, xl, zw, rzsj, jj}]}}
MANAGER_SCHEMA = ("struct<Result:struct<RptManagerList:array<struct<"
                  "xm:string,xb:string,nl:string,xl:string,zw:string,rzsj:string,jj:string>>>>")


_CORRUPT = "_corrupt"


def decode_payload(raw) -> Column:
    """Bytes -> text, UTF-8 when valid, else GBK."""
    b = F.col(raw) if isinstance(raw, str) else raw
    return F.coalesce(F.try_validate_utf8(b.cast("string")), F.decode(b, "GBK"))


def landed_payloads(spark, path: str, glob: str = "*") -> DataFrame:
    """S12 + T6 batch side: landed payload files -> (path, payload text),
    read as bytes (``binaryFile``) and decoded UTF-8-else-GBK in the JVM."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return raw.select("path", decode_payload("content").alias("payload"))


def epoch_minute(sec) -> Column:
    """epoch seconds -> ``yyyy-MM-dd HH:mm`` in the session zone (UTC)."""
    s = F.col(sec) if isinstance(sec, str) else sec
    return F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd HH:mm")


def bounded_pages(df: DataFrame, max_pages: int | None, page: str = "page") -> DataFrame:
    """Keep feed pages 1..max_pages (the crawler's page bound); None keeps all."""
    return df if max_pages is None else df.where(F.col(page) <= max_pages)


def _items(df: DataFrame, body: Column, schema: str, path: str, payload: str, keep, bad: str | None,
           options: dict | None = None) -> tuple[DataFrame, list[str]]:
    """The elements ``r`` of the array at ``path`` of a JSON text, and the columns to keep
    beside them; with ``bad`` a payload that does not parse is a row with ``r`` NULL."""
    if bad is None:
        parsed = df.select(*keep, F.from_json(body, schema, options or {}).alias("j"))
        return A.explode_rows(parsed, F.col(f"j.{path}"), "r", *keep), list(keep)
    schema = schema.replace("struct<", f"struct<{_CORRUPT}:string,", 1)
    parsed = df.select(*keep, F.col(payload).alias("_payload"),
                       F.from_json(body, schema, {**(options or {}), "columnNameOfCorruptRecord": _CORRUPT}).alias("j"))
    wrong = F.col(f"j.{_CORRUPT}").isNotNull() | F.col(f"j.{path}").isNull()
    text = F.when(wrong, F.coalesce("_payload", F.lit("")))
    rows = parsed.select(*keep, text.alias(bad), F.posexplode_outer(F.when(~wrong, F.col(f"j.{path}"))).alias("_pos", "r"))
    return rows.where(F.col("_pos").isNotNull() | F.col(bad).isNotNull()).drop("_pos"), [*keep, bad]


def split_bad(rows: DataFrame, bad: str) -> tuple[DataFrame, DataFrame]:
    """(good rows without ``bad``, quarantined rows) of a parser's output."""
    fields = [c for c in rows.columns if c != bad]
    return rows.where(F.col(bad).isNull()).select(*fields), rows.where(F.col(bad).isNotNull())


def watch(rows: DataFrame, bad: str, observation) -> DataFrame:
    """The same rows; ``observation`` has ``n_good`` and ``n_bad`` once they have been written."""
    return rows.observe(observation, F.count_if(F.col(bad).isNull()).alias("n_good"), F.count_if(F.col(bad).isNotNull()).alias("n_bad"))


def json_feed(df: DataFrame, payload: str = "payload", keep=(), bad: str | None = None) -> DataFrame:
    """Flatten ``result.data`` -> (url, title, pb_time)."""
    rows, kept = _items(df, F.col(payload), JSON_FEED_SCHEMA, "result.data", payload, keep, bad)
    return rows.select(*kept, "r.url", "r.title", epoch_minute(F.col("r.mtime").try_cast("bigint")).alias("pb_time"))


def js_feed(df: DataFrame, payload: str = "payload", keep=(), bad: str | None = None) -> DataFrame:
    """Text after the first '=', last char dropped, read as a lenient
    JSON object (unquoted keys, single quotes), flatten ``list``."""
    body = F.expr(f"substring(substring({payload}, instr({payload}, '=') + 1), 1, "
                  f"length(substring({payload}, instr({payload}, '=') + 1)) - 1)")
    rows, kept = _items(df, body, JS_FEED_SCHEMA, "list", payload, keep, bad,
                        {"allowUnquotedFieldNames": "true", "allowSingleQuotes": "true"})
    return rows.select(*kept, "r.url", "r.title", epoch_minute("r.time").alias("pb_time"))


def jsonp_feed(df: DataFrame, payload: str = "payload", keep=(), bad: str | None = None) -> DataFrame:
    """S3: the substring from the first '{' to the last '}', flatten ``result``."""
    body = F.regexp_extract(F.col(payload), r"(?s)(\{.*\})", 1)
    rows, kept = _items(df, body, JSONP_FEED_SCHEMA, "result", payload, keep, bad)
    return rows.select(*kept, "r.entityurl")


def manager_rows(df: DataFrame, payload: str = "payload", keep=(), bad: str | None = None) -> DataFrame:
    """Flatten ``Result.RptManagerList`` to one row per person."""
    rows, kept = _items(df, F.col(payload), MANAGER_SCHEMA, "Result.RptManagerList", payload, keep, bad)
    return (rows.withColumnRenamed("r", "m")
            .select(*kept, F.col("m.xm").alias("name"), F.col("m.xb").alias("sex"),
                    F.col("m.nl").alias("age"), F.col("m.xl").alias("edu"),
                    F.col("m.zw").alias("duty"), F.col("m.rzsj").alias("start_time"),
                    F.col("m.jj").alias("intro")))


def code_table(lines: DataFrame, line: str = "line", line_no: str = "line_no") -> DataFrame:
    """``code:name`` lines -> (code, name); lines that do not split in
    exactly two are skipped; both parts stripped; a later line overrides."""
    parts = F.split(T.strip_ws(line), ":")
    kv = (lines.select(line_no, parts.alias("p"))
          .where(F.size("p") == 2)
          .select(line_no, T.strip_ws(F.col("p")[0]).alias("code"), T.strip_ws(F.col("p")[1]).alias("name")))
    return kv.groupBy("code").agg(F.max_by("name", line_no).alias("name"))


def quotes(df: DataFrame, code: str = "code", payload: str = "payload") -> DataFrame:
    """Quote line -> (code, name, current, prev_close, delta, percent)."""
    d = F.split(F.col(payload), ",")
    cur = F.get(d, 3).try_cast("double")
    prev = F.get(d, 2).try_cast("double")
    first = F.get(d, 0)
    name = F.substring(first, F.instr(first, '"') + 1, F.length(first))
    out = df.select(code, name.alias("name"), cur.alias("current"), prev.alias("prev_close"))
    delta = F.col("current") - F.col("prev_close")
    return out.select("*", delta.alias("delta"),
                      F.when(F.col("prev_close") > 0, F.lit(100.0) * delta / F.col("prev_close"))
                      .otherwise(F.lit(0.0)).alias("percent"))
