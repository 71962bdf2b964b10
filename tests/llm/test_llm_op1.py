import hashlib

from llm_cases import common_lines, docs_frame, line_key

from newsflux.llm import op1_line_dedup as op1

ROWS = [(i, f"Own line {i}\n  Shared HEADER \t\nbody {i} é") for i in range(12)] + [
    (20, "shared header\nSHARED header\nx"), (21, None), (22, ""), (23, "\n\n"), (24, "Shared Header"),
    (25, "end\n"), (None, "no id\nshared header"), (26, "Ünshared header\n\x0bshared header\x0c\r"),
    (27, "very long " * 20000 + "\nshared header\n" + "tail" * 5000), (24, "Shared Header")]


def expected(rows, drop):
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if line_key(x) not in drop]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_common_lines_go_everywhere(spark):
    docs = docs_frame(spark, ROWS)
    cut = op1.apply_bitmaps(docs, op1.keep_bitmaps(docs, min_docs=10))
    got = [(r.doc_id, r["__n_lines"], r["__n_dropped"], r["__kept_text"]) for r in cut.collect()]
    distinct = {(d, t) for d, t in ROWS}  # equal rows are one document
    want = expected(ROWS, common_lines([t for _, t in distinct], 10))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(n for _, _, n, _ in got)


def test_first_occurrence_stays(spark):
    rows = [(3, "a\nb\na"), (1, "b\nc"), (2, "C\n a "), (4, "d")]
    docs = docs_frame(spark, rows)
    got = {r.doc_id: r.text for r in op1.drop_repeated_lines(docs, min_docs=2, keep_first=True).collect()}
    assert got == {1: "b\nc", 2: " a ", 3: "", 4: "d"}


def test_rewritten_table_keeps_columns(spark):
    docs = docs_frame(spark, ROWS)
    out = op1.drop_repeated_lines(docs, min_docs=10)
    assert out.columns == docs.columns
    by = {(r.doc_id, r.text): r.n_chars for r in out.collect()}
    assert all(n is None or n == len(t) for (_, t), n in by.items())
    assert (21, None) in by and (24, "") in by


def test_empty_table(spark):
    docs = docs_frame(spark, [])
    assert op1.apply_bitmaps(docs, op1.keep_bitmaps(docs)).count() == 0


def test_runs_are_compressed_and_native(spark):
    docs = docs_frame(spark, [(i, "x\ncommon\ny\nz") for i in range(10)])
    bitmaps = op1.keep_bitmaps(docs, min_docs=10)
    rows = bitmaps.where("d = 3").collect()
    assert rows[0].n_lines == 4 and rows[0].keep == []  # every line is common here
    docs = docs_frame(spark, [(i, f"x{i}\ncommon\ny{i}\nz{i}") for i in range(10)])
    bitmaps = op1.keep_bitmaps(docs, min_docs=10)
    keep = [tuple(r) for r in bitmaps.where("d = 3").first().keep]
    assert keep == [(0, 1), (2, 2)]
    plan = op1.apply_bitmaps(docs, bitmaps)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert hashlib.sha256(b"").hexdigest()  # the digest of an emptied text is that of ''
