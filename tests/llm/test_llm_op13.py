import hashlib
import zlib
from collections import defaultdict

from llm_cases import docs_frame

from newsflux.llm import op13_manifest as op13


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return digest(*map(field, (r.doc_id, r.source, r.lang, r.n_chars, text)))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        start = i // 3 * 3
        run = level[start:start + 3]
        out.append((run[:i - start], run[i - start + 1:]))
        i //= 3
    return out


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.source].append(r)
    for g in groups.values():
        g.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
    trees = {s: tree([leaf(r, r.text) for r in g]) for s, g in groups.items()}
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    top = tree([trees[s][-1][0] for s in order]) if order else [[None]]
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            way = path(trees[s], i) + path(top, k)
            text = r.text
            if text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0:
                text = text.replace("\n", "")
            h = leaf(r, text)
            for a, b in way:
                h = digest(*a, h, *b)
            out.append((r.doc_id, leaf(r, r.text), trees[s][-1][0], top[-1][0], digest(*(x for a, b in way for x in a + b)), h,
                        h == top[-1][0]))
    return sorted(out, key=repr)


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, "
                               "tree string, rank string")
    got = op13.audit(df).collect()
    assert sorted(map(tuple, got), key=repr) == brute(df.collect())
    return got


def test_sizes_around_powers(spark):
    rows, i = [], 0
    for n in (1, 2, 3, 4, 8, 9, 10, 27, 28, 82):
        for _ in range(n):
            rows.append((i, f"s{n}", "en", 3, f"a\nb {i}" if i % 3 else f"no break {i}"))
            i += 1
    got = check(spark, rows)
    assert {r.verified for r in got} == {True, False} and len({r.root for r in got}) == 1


def test_trees_of_several_blocks(spark):
    rows = [(i, "big" if i % 5 else "other", None, i, f"line {i}\n") for i in range(2 * op13.BLOCK + 5)]
    check(spark, rows)


def test_awkward_rows(spark):
    rows = [(1, None, None, None, None), (2, None, "en", 0, ""), (3, "", "en", 0, ""), (3, "é", "de", 2, "ä\n"), (3, "z", "", 1, "\n"),
            (None, "z", "x", 1, "a\nb"), (None, "z", "x", 1, "a\nb"), (7, "z", "x", 9, "same"), (7, "z", "x", 9, "same"),
            (7, "z", "x", 9, "other"), (-5, "z", "x", 9, "long \n" * 50000), (8, "Z", "-", -1, "1:a"), (9, "\U0001f600", "a", 1, "b"),
            (10, "￮", "a", 1, "b")]
    got = check(spark, rows)
    assert all(r.verified for r in got if r.doc_id is None)


def test_one_row_and_none(spark):
    one = check(spark, [(4, "a", "b", 1, "c")])
    assert one[0].leaf == one[0].subroot == one[0].root and one[0].proof_sha256 == digest()
    assert check(spark, []) == []


def test_equal_subtrees_are_one_record(spark):
    rows = [(None, "s", "en", 1, "copy")] * 81 + [(i, "s", "en", 1, "own") for i in range(81)]
    check(spark, rows)
    made = op13.build(docs_frame(spark, []).select("doc_id", "source", "lang", "n_chars", "text").union(
        spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")))
    assert made.below.where("height = 1").count() == 1 + 27 and made.below.where("height = 4").count() == 2


def test_proofs_of_some_leaves(spark):
    rows = [(i, f"s{i % 4}", "en", 1, f"t{i}") for i in range(400)]
    made = op13.build(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))
    every = {r.doc_id: r.path for r in op13.prove(made).collect()}
    some = {r.doc_id: r.path for r in op13.prove(made, made.leaves.where("doc_id % 50 = 7")).collect()}
    assert some == {i: p for i, p in every.items() if i % 50 == 7} and len(every) == 400


def test_any_change_is_seen(spark):
    rows = [(i, "s", "en", 1, f"t{i}") for i in range(20)]
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    roots = {op13.build(spark.createDataFrame([r if r[0] != k else (*r[:4], "other") for r in rows], schema)).root for k in (-1, 0, 19)}
    assert len(roots) == 3
