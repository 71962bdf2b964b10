"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

from newsflux.plans.oracle import WS, strip, unescape

from .op7_quality_rules import RULES

ORACLE: dict[str, str] = {}

_KEY = (r"translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), "
        "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

ORACLE["op1_line_dedup"] = f"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, lines, i, lines[i] AS line
  FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS i FROM docs)),
keyed AS (SELECT doc_id, lines, i, line, {_KEY} AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT (doc_id, lines)) >= 10)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE k IN (SELECT k FROM common)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i)
                       FILTER (WHERE k NOT IN (SELECT k FROM common)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id, lines
"""

# word arrays and shingles of whole texts; a shingle keeps its words apart by a
# blank, which no word holds
_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          r"'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')")

ORACLE["op5_ngram_join"] = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ')
         ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * o >= 90 * (x.n + y.n - o)),
reach AS (
  SELECT doc_id AS a, doc_id AS r FROM documents
  UNION SELECT l.a, reach.r FROM links l JOIN reach ON reach.a = l.b)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.a = d.doc_id
GROUP BY d.doc_id
"""

# turns with null roles and texts filled, and control marks in them opened
_TURNS = """
c AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
      FROM conversations WHERE conv_id IS NOT NULL),
cuts AS (SELECT conv_id, conv_id % count(*) AS cut FROM c GROUP BY conv_id),
chosen AS (SELECT conv_id AS pair, turn, role, text FROM c),
rejected AS (
  SELECT pair, turn, role, text FROM chosen JOIN cuts ON pair = conv_id WHERE turn < cut
  UNION ALL
  SELECT cuts.conv_id, turn, role, text FROM c JOIN cuts ON c.conv_id = cuts.conv_id + 1 WHERE turn >= cut)"""

ORACLE["op10_preference"] = f"""
WITH {_TURNS},
a AS (SELECT pair, turn, list_sort(list({{'r': role, 't': text}})) AS m FROM chosen GROUP BY ALL),
b AS (SELECT pair, turn, list_sort(list({{'r': role, 't': text}})) AS m FROM rejected GROUP BY ALL),
differs AS (
  SELECT coalesce(a.pair, b.pair) AS pair, min(coalesce(a.turn, b.turn)) AS d
  FROM a FULL JOIN b ON a.pair = b.pair AND a.turn = b.turn WHERE a.m IS DISTINCT FROM b.m GROUP BY 1),
parts AS (
  SELECT chosen.*, CASE WHEN d IS NULL OR turn < d THEN 'prompt' ELSE 'chosen' END AS part
  FROM chosen LEFT JOIN differs USING (pair)
  UNION ALL
  SELECT rejected.*, 'rejected' FROM rejected JOIN differs USING (pair) WHERE turn >= d),
pieces AS (
  SELECT pair, part, turn, role, replace(role, '<|', '< |') AS r, replace(text, '<|', '< |') AS t FROM parts),
placed AS (
  SELECT *, '<|' || r || '|>' || chr(10) || t || '<|end|>' || chr(10) AS piece,
         sum(length(r) + length(t) + 13) OVER (PARTITION BY pair, part ORDER BY turn, r, t ROWS UNBOUNDED PRECEDING) AS stop
  FROM pieces)
SELECT pair AS conv_id,
  coalesce(string_agg(piece, '' ORDER BY turn, r, t) FILTER (WHERE part = 'prompt'), '') AS prompt,
  coalesce(string_agg(piece, '' ORDER BY turn, r, t) FILTER (WHERE part = 'chosen'), '') AS chosen,
  coalesce(string_agg(piece, '' ORDER BY turn, r, t) FILTER (WHERE part = 'rejected'), '') AS rejected,
  coalesce(string_agg((stop - length(t) - 8) || '-' || (stop - 1), ',' ORDER BY turn, r, t)
           FILTER (WHERE part = 'chosen' AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg((stop - length(t) - 8) || '-' || (stop - 1), ',' ORDER BY turn, r, t)
           FILTER (WHERE part = 'rejected' AND role = 'assistant'), '') AS rejected_spans,
  count(DISTINCT turn) FILTER (WHERE part = 'prompt') AS n_prompt_turns,
  count(*) FILTER (WHERE part = 'chosen' AND role = 'assistant') > 0
  AND count(*) FILTER (WHERE part = 'rejected' AND role = 'assistant') > 0 AS usable
FROM placed GROUP BY pair
"""

ORACLE["op3_merkle_audit"] = """
WITH p AS (SELECT DISTINCT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
           WHERE page_id IS NOT NULL),
bodies AS (
  SELECT *, page_id % 97 AS damage,
         CASE page_id % 97
           WHEN 0 THEN (CASE WHEN html LIKE '#%' THEN '!' ELSE '#' END) || substr(html, 2)
           WHEN 1 THEN substr(html, 1, length(html) // 2) ELSE html END AS bad FROM p),
sized AS (
  SELECT *, 74 + strlen(url) + length(strlen(html)::VARCHAR) + strlen(html) AS length_a,
         74 + strlen(url) + length(strlen(bad)::VARCHAR) + strlen(bad) AS length_b FROM bodies),
placed AS (
  SELECT *, 'pages-' || (page_id // 256) AS archive,
         sum(length_a) OVER (PARTITION BY page_id // 256 ORDER BY page_id) - length_a AS "offset" FROM sized)
SELECT archive, "offset", length_a, CASE WHEN damage = 2 THEN NULL ELSE length_b END AS length_b,
       CASE WHEN damage = 2 THEN 'missing' WHEN length_a = length_b THEN 'corrupt' ELSE 'resized' END AS status
FROM placed WHERE damage = 2 OR bad <> html
"""

# every word with its followers, so that windows of 3 to 10 words are strings;
# words hold no blanks, so joined windows are equal only if all words are
_LENGTHS = [n for n, _ in RULES.max_window_share]
_LEADS = ", ".join(f"lead(w, {k}) OVER text_order AS w{k}" for k in range(1, max(_LENGTHS)))
_WINDOWS = " UNION ALL ".join(
    f"SELECT doc_id, i, {n} AS n, concat_ws(' ', w, {', '.join(f'w{k}' for k in range(1, n))}) AS key "
    f"FROM followed WHERE w{n - 1} IS NOT NULL" for n in (3, *_LENGTHS))
# customary limits where the later copies are long or stand at several places, else the wider ones
_TOO_MUCH = " OR ".join(
    f"window_chars[{i + 1}] > (CASE WHEN window_words[{i + 1}] > {RULES.max_copy_words} OR window_places[{i + 1}] > 1 "
    f"THEN {min(share, dict(RULES.max_copies_share)[n])} ELSE {share} END) * word_chars"
    for i, (n, share) in enumerate(RULES.max_window_share))
_PER_LENGTH = lambda column: ("[" + ", ".join(f"coalesce(max({column}) FILTER (WHERE n = {n}), 0)" for n in _LENGTHS)
                              + "]::BIGINT[]")
_NO_LENGTHS = f"[{', '.join('0' for _ in _LENGTHS)}]::BIGINT[]"

ORACLE["op7_quality_rules"] = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w,
         generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM texts),
followed AS (SELECT doc_id, i, w, {_LEADS} FROM words WINDOW text_order AS (PARTITION BY doc_id ORDER BY i)),
windows AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, n, key) AS c, row_number() OVER (PARTITION BY doc_id, n, key ORDER BY i) AS rn
  FROM ({_WINDOWS})),
covered AS (
  SELECT DISTINCT doc_id, n, i + unnest(range(n)) AS i FROM windows WHERE (n = 3 AND c > 1) OR (n > 3 AND rn > 1)),
places AS (SELECT *, i - 1 IS DISTINCT FROM lag(i) OVER (PARTITION BY doc_id, n ORDER BY i) AS begins FROM covered),
by_length AS (
  SELECT doc_id, n, count(*) AS n_words, sum(length(w)) AS chars, count(*) FILTER (WHERE begins) AS n_places
  FROM places JOIN words USING (doc_id, i) GROUP BY ALL),
measured AS (
  SELECT doc_id, max(n_words) FILTER (WHERE n = 3) AS n_repeat_words, {_PER_LENGTH('chars')} AS window_chars,
         {_PER_LENGTH('n_words')} AS window_words, {_PER_LENGTH('n_places')} AS window_places
  FROM by_length GROUP BY doc_id),
lines AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS rn
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (
  SELECT doc_id, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS dup_line_chars
  FROM lines WHERE rn > 1 GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars FROM words GROUP BY doc_id),
base AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars,
         coalesce(window_chars, {_NO_LENGTHS}) AS window_chars, coalesce(window_words, {_NO_LENGTHS}) AS window_words,
         coalesce(window_places, {_NO_LENGTHS}) AS window_places
  FROM texts LEFT JOIN counts USING (doc_id) LEFT JOIN measured USING (doc_id) LEFT JOIN dup USING (doc_id))
SELECT * EXCLUDE (window_words, window_places), n_words < {RULES.min_words} OR 100 * n_repeat_words > {RULES.max_repeat_words_pct} * n_words AS base_failed,
       NOT (n_words < {RULES.min_words} OR 100 * n_repeat_words > {RULES.max_repeat_words_pct} * n_words
            OR {_TOO_MUCH} OR dup_line_chars > {RULES.max_line_share} * word_chars) AS kept
FROM base
"""

# the given documents hold benchmark items word for word: every such pair must be
# found and no other (templates with other values are in the tests)
ORACLE["op6_decontaminate"] = r"""
SELECT doc_id, item_id, n AS n_covered, n AS n_item_words, true AS verbatim
FROM documents d JOIN (
  SELECT item_id, text, len(list_filter(regexp_extract_all(text, '[^\x20\x09-\x0D]+'),
                                        lambda w: regexp_matches(w, '[0-9A-Za-z\x{80}-\x{10FFFF}]'))) AS n FROM benchmark) b
ON contains(lower(d.text), lower(b.text))
"""

# in the given pages the article holds headings and paragraphs, with bold words
# and line breaks inside
_BLOCK = unescape("regexp_replace(x, '</?b>|<br>', ' ', 'g')")
ORACLE["op9_html_text"] = rf"""
SELECT page_id, url, text, length(text) AS n_chars FROM (
  SELECT page_id, url, array_to_string(list_filter(list_transform(
           regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>'),
           lambda x: regexp_replace({strip(_BLOCK)}, '{WS}+', ' ', 'g')), lambda x: length(x) > 0), chr(10)) AS text
  FROM pages)
"""

ORACLE["op12_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, v.vec_id, v.label,
         list_sum(list_transform(list_zip(a.e, v.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE label <> anchor_label AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""

# crc32 of a doc_id in decimals: a byte, then eight shifts (-1) for it
_CRC32 = ("xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''), "
          "lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), "
          "lambda c, t: CASE WHEN t >= 0 THEN xor(c, t) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))")
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0} END"
_LEAF = "sha256({})".format(" || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text")))


def _merkle(name: str, levels: int) -> str:
    """CTEs {name}0 (tree, pos, d, n) up to {name}{levels}: runs of 3 hashed into one."""
    return ", ".join(f"""{name}{k + 1} AS MATERIALIZED (
  SELECT tree, pos // 3 AS pos, CASE WHEN any_value(n) = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY pos)) END AS d,
         (any_value(n) + 2) // 3 AS n FROM {name}{k} GROUP BY tree, {name}{k}.pos // 3)""" for k in range(levels))


def _climb(name: str, nodes: str, levels: int) -> str:
    """CTEs {name}0 (id, tree, pos, h, proof) up to {name}{levels}: h hashed with the run's others."""
    return ", ".join(f"""{name}{k + 1} AS MATERIALIZED (
  SELECT w.id, w.tree, w.pos // 3 AS pos,
         CASE WHEN any_value(n) = 1 THEN any_value(h)
              ELSE sha256(string_agg(CASE WHEN s.pos = w.pos THEN h ELSE d END, '' ORDER BY s.pos)) END AS h,
         any_value(proof) || coalesce(string_agg(d, '' ORDER BY s.pos) FILTER (WHERE s.pos <> w.pos), '') AS proof
  FROM {name}{k} w JOIN {nodes}{k} s ON s.tree = w.tree AND s.pos // 3 = w.pos // 3
  GROUP BY w.id, w.tree, w.pos)""" for k in range(levels))


# levels enough for 3 ** 10 documents of a source and as many sources
_LEVELS = 10
ORACLE["op13_manifest"] = f"""
WITH base AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS id, {_LEAF} AS leaf,
         {_LEAF.replace('text', 't2')} AS offered,
         dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree, source
  FROM (SELECT *, CASE WHEN {_CRC32} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS t2 FROM documents)),
a0 AS MATERIALIZED (
  SELECT id, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS d,
         count(*) OVER (PARTITION BY tree) AS n FROM base),
{_merkle('a', _LEVELS)},
b0 AS MATERIALIZED (SELECT 0 AS tree, tree AS pos, d, count(*) OVER () AS n FROM a{_LEVELS}),
{_merkle('b', _LEVELS)},
u0 AS MATERIALIZED (SELECT a0.id, a0.tree, pos, offered AS h, '' AS proof FROM a0 JOIN base USING (id)),
{_climb('u', 'a', _LEVELS)},
w0 AS MATERIALIZED (SELECT id, 0 AS tree, tree AS pos, h, proof FROM u{_LEVELS}),
{_climb('w', 'b', _LEVELS)}
SELECT doc_id, leaf, s.d AS subroot, r.d AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = r.d AS verified
FROM base JOIN w{_LEVELS} USING (id) JOIN a{_LEVELS} s ON s.tree = base.tree CROSS JOIN b{_LEVELS} r
"""
