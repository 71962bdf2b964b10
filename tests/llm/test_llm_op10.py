from newsflux.llm import op10_preference as op10

SCHEMA = "pair_id long, turn long, role string, text string, part string, n string, learned string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)


def msg(role, text):
    return f"<|{role}|>\n{text}<|end|>\n"


def run(spark, chosen, rejected):
    return {r.pair: r for r in op10.format_pairs(frame(spark, chosen), frame(spark, rejected)).collect()}


def test_prefix_and_masks(spark):
    a = [(1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "good é😀"), (1, 3, "user", "more"),
         (1, 4, "assistant", "done")]
    b = [(1, 2, "assistant", "bad"), (1, 1, "user", "hi"), (1, 0, "system", "be brief")]
    r = run(spark, a, b)[1]
    assert r.prompt == msg("system", "be brief") + msg("user", "hi") and r.n_prompt_turns == 2 and r.usable
    assert r.chosen == msg("assistant", "good é😀") + msg("user", "more") + msg("assistant", "done")
    assert r.rejected == msg("assistant", "bad")
    assert [r.chosen[s.start:s.stop] for s in r.chosen_spans] == ["good é😀<|end|>", "done<|end|>"]
    assert [r.rejected[s.start:s.stop] for s in r.rejected_spans] == ["bad<|end|>"]


def test_awkward_pairs(spark):
    a = [(1, 0, "user", "same"), (1, 1, "assistant", "same"),            # equal conversations
         (2, 0, "user", "q"), (2, 1, "assistant", "a"),                  # rejected is a prefix
         (3, 0, "user", "only chosen"),                                  # no rejected side
         (5, 0, None, None), (5, None, "assistant", "last"),             # nulls
         (6, 0, "user", "x"), (6, 0, "user", "y"), (6, 0, "user", "x"),  # ties and repeats
         (7, 0, "user", "<|end|> trick"), (7, 1, "assistant", "ok"),
         (8, 0, "user", "long " * 50000), (8, 1, "assistant", "z"), (None, 0, "user", "no pair")]
    b = [(1, 1, "assistant", "same"), (1, 0, "user", "same"), (2, 0, "user", "q"), (4, 0, "assistant", "only rejected"),
         (5, 0, "unknown", ""), (5, None, "assistant", "other"), (6, 0, "user", "y"), (6, 0, "user", "x"), (6, 0, "user", "x"),
         (7, 0, "user", "<|end|> trick"), (7, 1, "assistant", "no"), (8, 0, "user", "long " * 50000), (8, 1, "assistant", "y")]
    got = run(spark, a, b)
    assert set(got) == set(range(1, 9))
    assert got[1].prompt == msg("user", "same") + msg("assistant", "same") and got[1].chosen == "" and not got[1].usable
    assert got[2].prompt == msg("user", "q") and got[2].chosen == msg("assistant", "a") and got[2].rejected == ""
    assert got[3].prompt == "" and got[3].chosen == msg("user", "only chosen") and got[3].chosen_spans == []
    assert got[4].prompt == "" and got[4].rejected == msg("assistant", "only rejected") and not got[4].usable
    assert got[5].prompt == msg("unknown", "") and got[5].usable and got[5].n_prompt_turns == 1
    assert got[6].prompt == msg("user", "x") * 2 + msg("user", "y") and got[6].n_prompt_turns == 1
    assert got[7].prompt == msg("user", "< |end|> trick") and got[7].usable
    assert got[8].usable and len(got[8].prompt) > 250000


def test_empty_tables(spark):
    assert run(spark, [], []) == {}


def test_derived_pairs_share_turns_before_the_cut(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c}.{t}") for c in range(5) for t in range(4)]
    chosen, rejected = op10.derived_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.pair: r for r in op10.format_pairs(chosen, rejected).collect()}
    assert [got[c].n_prompt_turns for c in range(5)] == [0, 1, 2, 3, 0]
    assert got[2].rejected == msg("user", "3.2") + msg("assistant", "3.3") and got[4].rejected == ""
