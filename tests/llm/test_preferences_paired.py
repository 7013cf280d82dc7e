"""Side-by-side completions, and the query's plan against the general operator."""

from quarrykit.llm import preference_format as pf
from quarrykit.llm.queries import QUERIES

TURNS = "pair_id bigint, turn bigint, role string, text string"


def test_side_by_side(spark):
    a = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "q"), (3, 0, "user", "only"), (None, 0, "user", "x")], TURNS)
    b = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "assistant", "more"), (2, 0, "user", "q"), (4, 0, None, None)], TURNS)
    got = {(r.pair_id, r.turn): r for r in pf.pair_completions(a, b).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (2, 0), (3, 0), (4, 0)}
    r = got[1, 1]
    assert r.prompt is None and r.chosen == "<|assistant|>\nyes<|end|>\n" and r.rejected == "<|assistant|>\nno<|end|>\n"
    assert r.chosen[r.chosen_mask_start :][: r.chosen_mask_length] == "yes<|end|>\n" and r.rejected[r.rejected_mask_start :][: r.rejected_mask_length] == "no<|end|>\n"
    assert got[1, 2].chosen is None and got[1, 2].chosen_mask_length == 0 and got[1, 2].rejected_mask_length == 12
    assert got[1, 0].prompt == got[1, 0].prompt and got[1, 0].chosen is None and got[2, 0].prompt == "<|user|>\nq<|end|>\n"
    assert got[4, 0].rejected == "<|user|>\n<|end|>\n" and got[4, 0].prompt is None
    assert pf.pair_completions(a.limit(0), b.limit(0)).collect() == []


def test_query_equals_operator(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 1, "system", "z"), (3, 0, "user", None), (4, None, None, "t"), (5, 3, "assistant", "x" * 1_000_000), (6, 0, "assistant", "y"), (None, 0, "assistant", "y")]
    c = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, said string, pair_id int")
    want = sorted(map(tuple, pf.format_preferences(*pf.swapped_replies(c)).collect()))
    assert sorted(map(tuple, pf.swapped_preferences(c).collect())) == want and want
    assert pf.swapped_preferences(c.limit(0)).collect() == []
    assert QUERIES["op1_preference_format"]
