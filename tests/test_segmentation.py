import itertools
import math
import random

import pytest

from newsflux.operators import segmentation as S


def every_cut(run):
    for borders in itertools.product((False, True), repeat=len(run) - 1):
        out, at = [], 0
        for i, b in enumerate(borders, 1):
            if b:
                out.append(run[at:i])
                at = i
        yield [*out, run[at:]]


def test_dictionary_path_is_the_best_of_all_cuts():
    rng = random.Random(5)
    for _ in range(60):
        chars = "天地人山水火"[:rng.randint(2, 6)]
        words = {"".join(rng.choice(chars) for _ in range(rng.randint(1, 4))): rng.randint(1, 500) for _ in range(rng.randint(1, 14))}
        s = S.Segmenter(words, {}, {})
        total = sum(words.values())

        def score(cut):
            if any(w not in words and len(w) > 1 for w in cut):
                return -math.inf
            return sum(math.log(words.get(w, 1) / total) for w in cut)

        for _ in range(8):
            run = "".join(rng.choice(chars) for _ in range(rng.randint(1, 9)))
            got = s.by_dictionary(run)
            assert "".join(got) == run
            assert score(got) == pytest.approx(max(score(c) for c in every_cut(run)), abs=1e-9)


def test_model_path_is_the_best_of_all_state_sequences():
    rng = random.Random(6)
    for _ in range(40):
        chars = "天地人山"
        emitted = {(s, c): rng.randint(1, 40) for s in range(4) for c in chars if rng.random() < 0.8}
        moved = {(a, b): rng.randint(0, 30) for a, bs in S.NEXT.items() for b in bs}
        s = S.Segmenter({}, emitted, moved)

        def states(cut):
            return [k for w in cut for k in ([S.SINGLE] if len(w) == 1 else [S.FIRST, *[S.INNER] * (len(w) - 2), S.LAST])]

        def score(run, cut):
            st = states(cut)
            p = s.start[st[0]] + sum(s.move[a, b] for a, b in itertools.pairwise(st))
            return p + sum(s.emit[k].get(c, s.rare[k]) for k, c in zip(st, run, strict=True))

        for _ in range(6):
            run = "".join(rng.choice(chars + "火") for _ in range(rng.randint(1, 8)))
            got = s.by_model(run)
            assert "".join(got) == run
            assert score(run, got) == pytest.approx(max(score(run, c) for c in every_cut(run)), abs=1e-9)


def test_lines_of_mixed_script():
    s = S.Segmenter({"中国": 50, "经济": 40, "增长": 30, "中": 5, "国": 5}, {(S.FIRST, "新"): 9, (S.LAST, "股"): 9}, {(S.FIRST, S.LAST): 9})
    assert s.cut("中国经济增长3.5%，GDP 新股 x_y") == ["中国", "经济", "增长", "3.5", "%", "，", "GDP", "新股", "x", "_", "y"]
    assert s.cut("") == [] and s.cut(" \t\n") == []
    assert S.Segmenter({}, {}, {}).cut("天地人") != [] and "".join(S.Segmenter({}, {}, {}).cut("天地人")) == "天地人"


def test_learned_counts_and_column(spark):
    lines = spark.createDataFrame([("中国 经济 增长",), ("经济 很 好 abc",), (None,), ("",), ("新 中国 经济学家",)], "line string")
    s = S.learn(lines)
    assert set(s.words) == {"中国", "经济", "增长", "很", "好", "新", "经济学家"}
    assert s.words["经济"] > s.words["增长"] == s.words["很"]
    # first -> last: 中国 x2, 经济 x2, 增长; first -> inner, inner -> inner, inner -> last: 经济学家
    plain = S.Segmenter({"中国": 2, "经济": 2, "增长": 1, "很": 1, "好": 1, "新": 1, "经济学家": 1},
                        {(S.FIRST, "中"): 2, (S.LAST, "国"): 2, (S.FIRST, "经"): 3, (S.LAST, "济"): 2, (S.INNER, "济"): 1,
                         (S.INNER, "学"): 1, (S.LAST, "家"): 1, (S.FIRST, "增"): 1, (S.LAST, "长"): 1, (S.SINGLE, "很"): 1,
                         (S.SINGLE, "好"): 1, (S.SINGLE, "新"): 1},
                        {(S.FIRST, S.LAST): 5, (S.FIRST, S.INNER): 1, (S.INNER, S.INNER): 1, (S.INNER, S.LAST): 1,
                         (S.LAST, S.FIRST): 3, (S.LAST, S.SINGLE): 1, (S.SINGLE, S.SINGLE): 1, (S.SINGLE, S.FIRST): 1})
    assert s.emit == plain.emit and s.move == plain.move and s.start == plain.start
    cut = S.segmenter(spark, s)
    got = spark.createDataFrame([("新中国经济",), (None,), ("",), ("经济学家很好",)], "x string").select(cut("x").alias("w")).collect()
    assert [r.w for r in got] == ["新 中国 经济", None, "", "经济学家 很 好"]
    assert set(S.learn(lines, max_words=2).words) == {"中国", "经济"}


class _Asked(dict):
    times = 0

    def get(self, *key):
        self.times += 1
        return super().get(*key)


def test_a_long_word_does_not_slow_the_others():
    long_ = "天地" + "人" * 500
    s = S.Segmenter({long_: 1, "天地": 9, "山水": 9, "天地山": 2}, {}, {})
    s.words = asked = _Asked(s.words)
    line = "天地山水" * 200
    assert s.cut(line) == ["天地", "山水"] * 200
    assert asked.times <= 5 * len(line)  # not one for every length up to the longest word's
    asked.times = 0
    assert s.cut("山水天地" * 200) == ["山水", "天地"] * 200 and asked.times <= 20  # parts met before
    assert s.cut(long_ + "山水") == [long_, "山水"]


def test_parts_are_cut_as_the_whole(monkeypatch):
    monkeypatch.setattr(S, "MAX_MET", 3)
    rng = random.Random(8)
    for _ in range(40):
        chars = "天地人山水火木金"[:rng.randint(3, 8)]
        s = S.Segmenter({"".join(rng.choice(chars) for _ in range(rng.randint(1, 4))): rng.randint(1, 500) for _ in range(12)}, {}, {})
        score = lambda cut: sum(s.words.get(w, s.unknown) for w in cut)  # noqa: B023, E731
        for _ in range(8):
            run = "".join(rng.choice(chars + "雷") for _ in range(rng.randint(1, 30)))
            parts = s.parts(run)
            assert "".join(parts) == run == "".join(s.run(run))
            assert score([w for p in parts for w in s.of_part(p)]) == pytest.approx(score(s.by_dictionary(run)), abs=1e-9)


def test_counts_are_handed_over_in_parts(spark, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(S, "MAX_MET", 2)
    lines = ["中国 经济 abc 好", None, "", "中国 x好 增长\t中国"]
    got = [r for b in S._count(pa.RecordBatch.from_arrays([pa.array([x], pa.string())], ["line"]) for x in lines) for r in b.to_pylist()]
    n = {}
    for r in got:
        n[r["word"], r["a"], r["b"]] = n.get((r["word"], r["a"], r["b"]), 0) + r["n"]
    assert n == {("中国", None, None): 3, ("经济", None, None): 1, ("好", None, None): 1, ("增长", None, None): 1,
                 (None, True, True): 3, (None, True, False): 1}
