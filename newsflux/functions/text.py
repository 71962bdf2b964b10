"""Text column expressions (F1-F8, F12, F16) — all JVM-side, no Python per row.

Python's ``str.strip()`` / ``str.split()`` / ``re`` ``\\s`` treat a specific
set of code points as whitespace; Java's ``\\s`` is ASCII only and ``trim``
strips only U+0020, so we spell the class out.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Whitespace code points of Python's str.isspace() in the BMP.
WS_CLASS = (r"[\t\n\x0B\f\r\x1c-\x1f \x{85}\x{A0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
# The same code points as a character set (for btrim): tab, LF, VT, FF, CR,
# U+001C-U+001F, space, U+0085, NBSP, U+1680, U+2000-U+200A, U+2028, U+2029,
# U+202F, U+205F, U+3000.
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
            "\u2028\u2029\u202f\u205f\u3000")
# -----------------------------------------------------------------------------

NBSP = " "


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(x) -> Column:
    """Python ``s.strip()`` (character-set trim, no regex)."""
    return F.btrim(_c(x), F.lit(WS_CHARS))


def remove_multi_space(x) -> Column:
    """NBSP -> space, then every run of 2+ whitespace -> one space."""
    return F.regexp_replace(F.replace(_c(x), F.lit(NBSP), F.lit(" ")), f"{WS_CLASS}{{2,}}", " ")


def remove_html_space(x) -> Column:
    """delete NBSP."""
    return F.replace(_c(x), F.lit(NBSP), F.lit(""))


def remove_newline(x) -> Column:
    """newline -> space."""
    return F.regexp_replace(_c(x), "\n", " ")


def clean(x) -> Column:
    """``remove_multi_space(x).strip()`` — the usual title/paragraph cleanup."""
    return strip_ws(remove_multi_space(x))


def split_ws(x) -> Column:
    """Python ``s.split()`` (no separator): no empty tokens, [] for blank."""
    s = strip_ws(x)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, f"{WS_CLASS}+"))


def count_tokens(x) -> Column:
    """``len(s.split())`` without building the token array."""
    s = strip_ws(x)
    return F.when(s == "", F.lit(0)).otherwise(F.regexp_count(s, F.lit(f"{WS_CLASS}+")) + 1)


def segment(x) -> Column:
    """V2 default segmenter: whitespace tokens joined by one space
    (``" ".join(s.split())``, done as one replace over the stripped text)."""
    return F.regexp_replace(strip_ws(x), f"{WS_CLASS}+", " ")


def count_char(x, ch: str) -> Column:
    """``s.count(ch)`` for a one-character ``ch``."""
    return F.length(_c(x)) - F.length(F.replace(_c(x), F.lit(ch), F.lit("")))


def named_references() -> dict[str, str]:
    """The named character references of HTML (the standard library's table)."""
    return {name[:-1]: chars for name, chars in html5.items() if name.endswith(";")}


def unescape_html(x) -> Column:
    """Character references with their semicolon, decimal, hexadecimal or named,
    decoded once; anything else that follows an ampersand stays as it is."""
    names = F.from_json(F.lit(json.dumps(named_references())), "map<string,string>")
    code = lambda s: F.when(s.startswith("#x") | s.startswith("#X"), F.conv(F.substring(s, 3, 8), 16, 10)) \
        .otherwise(F.substring(s, 2, 10)).try_cast("int")

    def piece(p: Column) -> Column:
        ref = F.regexp_extract(p, r"^(#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});", 1)
        n = code(ref)
        char = (F.when(~ref.startswith("#"), F.try_element_at(names, ref))
                .when((n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF),
                      F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))
        rest = F.substring(p, F.length(ref) + 2, F.length(p))
        return F.when((ref != "") & char.isNotNull(), F.concat(char, rest)).otherwise(F.concat(F.lit("&"), p))

    s = _c(x)
    parts = F.split(s, "&", -1)
    return F.when(~s.contains("&"), s).otherwise(
        F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), piece), "")))


def strip_tags(x) -> Column:
    return F.regexp_replace(_c(x), r"<[^>]*>", "")


def html_text(x) -> Column:
    """Visible text of an HTML fragment: tags removed, entities decoded, cleaned."""
    return clean(unescape_html(strip_tags(x)))


def fmt2(x) -> Column:
    """F12 ``"{:.2f}"`` (no grouping, Python rounding of the binary value)."""
    return F.call_function("format_number", _c(x), F.lit("0.00"))


def fmt2_signed(x) -> Column:
    """F12 ``"{:+.2f}"``."""
    return F.call_function("format_number", _c(x), F.lit("+0.00;-0.00"))


def delete_at(arr, idx) -> Column:
    """Delete the 1-based position ``idx``; idx < 1 or past the end is a no-op."""
    a, i = _c(arr), _c(idx)
    return F.when((i < 1) | (i > F.size(a)), a).otherwise(
        F.concat(F.slice(a, F.lit(1), i - 1), F.slice(a, i + 1, F.greatest(F.size(a) - i, F.lit(0)))))


# fixed values: publication-time formats seen across sources (H6)
PB_TIME_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy年MM月dd日 HH:mm", "yyyy年MM月dd日HH:mm",
                   "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy-MM-dd"]


def parse_pb_time(x) -> Column:
    """H6: the raw ``pb_time`` text of any source as ``timestamp_ntz``
    (first format that parses; NULL when none does). The raw string is kept
    for reference-faithful ordering; this column gives a sane one."""
    s = strip_ws(x)
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)).cast("timestamp_ntz") for f in PB_TIME_FORMATS])
