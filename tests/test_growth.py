"""Work that grew faster than its input, or sat on one task."""

import difflib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrykit.functions import spelling, text
from quarrykit.operators import columns, correlate, matrix, outliers, profile
from quarrykit.plans import lineage


def test_matching_blocks_are_difflibs():
    rng = random.Random(5)
    for k in range(600):
        letters = ("ab", "abcd", "the qéü字")[k % 3]
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randint(0, 300 if k % 20 == 0 else 50))) for _ in range(2))
        want = difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
        for least in (1, 2, 4):
            for most in (4_000_000, 20):
                assert sorted(text.matching_blocks(a, b, least, most)) == sorted((i, n) for i, _, n in want if n >= least)


def test_phrase_groups_are_spread(spark):
    rows = [(g, k, f"list {g} holds the text {k} twice over") for g in range(40) for k in range(3)]
    got = text.extract_phrases(spark.createDataFrame(rows, "g int, o int, t string"), "g", "o", "t", 5)
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {r.g for r in got.collect()} == set(range(40))


def test_cosines_of_odd_rows(spark):
    rows = [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [4.0, -3.0]), (4, None), (5, [1.0, None]), (6, [2.0]), (7, []), (8, [6.0, 8.0])]
    for blocks in (1, 3):
        frame = matrix.cosine_rows(spark.createDataFrame(rows, "id int, x array<float>"), "id", "x", blocks)
        assert frame.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
        got = {(r.i, r.j): r.v for r in frame.collect()}
        assert len(got) == 64 and got[1, 3] == 0 and got[1, 8] == got[8, 1] == got[6, 6] == 1
        assert {k for k, v in got.items() if v is not None} == {(i, j) for i in (1, 3, 8) for j in (1, 3, 8)} | {(6, 6)}


def test_pairs_of_blocks_are_spread(spark):
    rows = [(k, float(k) if k % 7 else None) for k in range(50)]
    frame = matrix.pairwise_difference(spark.createDataFrame(rows, "id int, x double"), "id", "x", 3)
    assert frame.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {(r.i, r.j): r.v for r in frame.collect()}
    assert got == {(a, b): None if x is None or y is None else y - x for a, x in rows for b, y in rows}


def test_fuzzy_index_finds_all():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(0, 14))) for _ in range(150)]
    words += [w[:k] + rng.choice("abcdef") + w[k + rng.randint(0, 1) :] for w in words for k in [rng.randint(0, len(w))]]
    words += [w * 4 for w in words[:20]] + [(w * 4)[3:] + "xy" for w in words[:20]]
    ratio = {(a, b): round(100 * difflib.SequenceMatcher(None, b, a, autojunk=False).ratio()) for a in words[::2] for b in words}
    for threshold in (0, 40, 75, 90, 100):
        index = spelling.FuzzyIndex(words, threshold)
        near = {a: set(index.near(a)) for a in words[::2]}
        assert all(b in near[a] for (a, b), r in ratio.items() if r >= threshold)
    assert sum(map(len, near.values())) < len(ratio) / 50


def test_fuzzy_words_are_spread(spark):
    words = spark.createDataFrame([(f"word{k % 50}",) for k in range(100)], "w string")
    got = spelling.fuzzy_matches(words, spark.createDataFrame([("word7",), (None,)], "word string"), 90, block=1)
    assert sorted(map(tuple, got.collect())) == [(f"word{k}7" if k else "word7", "word7", 91 if k else 100) for k in (1, 2, 3, 4, 0)]
    assert got.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_compounding_with_blanks_and_hyphens(spark):
    lines = ["co op coop co-op co op", "co op  coop", None, "", "co-op co-op", "-- a", " ", "rain bow x", "rainbow"]
    docs = spark.createDataFrame([(x,) for x in lines], "t string")
    known = spark.createDataFrame([("rain",), ("bow",), ("rainbow",), (None,)], "word string")
    got = text.compounding_decisions(docs, "t", known).collect()
    texts = [[*x.split(" ")] for x in lines if x is not None]
    pairs = {(a, b) for t in texts for a, b in zip(t, t[1:])}
    plain = {w for t in texts for w in t if "-" not in w}
    want = {(f"{a} {b}", a + b, sum((a, b) in zip(t, t[1:]) for t in texts), sum(any(w.replace("-", "") == a + b for w in t) for t in texts)) for a, b in pairs if a + b in plain}
    assert {(r.bigram, r.joined, r.n_bigram, r.n_joined) for r in got} == want
    assert {r.make_bigram for r in got if r.bigram == "rain bow"} == {True}


def test_pairs_never_joined_are_not_shuffled(spark):
    keys = spark.createDataFrame([(f"k{n}",) for n in range(500)], "w string")
    rows = spark.createDataFrame([(f"k{n}",) for n in range(0, 20000, 2)] + [(None,)], "t string")
    got = {r.t for r in text._maybe_in(rows, F.col("t"), keys).collect()}
    assert {f"k{n}" for n in range(0, 500, 2)} <= got and len(got) < 260


def test_profile_counts_by_value(spark):
    rows = [(k % 3, f"s{k}" if k % 4 else None, float(k)) for k in range(20)]
    frame = spark.createDataFrame(rows, "a int, b string, c double")
    got = {r.column: tuple(r)[2:] for r in columns.column_profile(frame).collect()}
    assert got == {"a": (20, 0, 3, "0", "2"), "b": (20, 5, 15, "s1", "s9"), "c": (20, 0, 20, "0.0", "19.0")}
    none = {tuple(r)[2:] for r in columns.column_profile(frame.filter("false")).collect()}
    assert none == {(0, 0, 0, None, None)}


@pytest.mark.parametrize("by", ["g", None])
def test_box_stats_hold_no_column(spark, by):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", "c"]), rng.choice([None, rng.randint(0, 9) / 2, rng.gauss(0, 30)])) for _ in range(500)] + [("one", 7.5), ("none", None)]
    frame = spark.createDataFrame(rows, "g string, x double")
    out = profile.box_stats(frame, "x", by)
    assert "percentile" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.asDict().get("by"): r for r in out.collect()}
    for g in {g for g, x in rows if x is not None} if by else {None}:
        x = np.array([v for k, v in rows if v is not None and (not by or k == g)])
        q1, median, q3 = np.quantile(x, [0.25, 0.5, 0.75])
        inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
        r = got.pop(g)
        assert np.allclose([r.q1, r.median, r.q3, r.low, r.high], [q1, median, q3, inside.min(), inside.max()], rtol=1e-12)
        assert (r.n, r.outliers) == (len(x), len(x) - len(inside))
    assert not got


@pytest.mark.parametrize("sent", [0, 5, 200_000])
def test_ranks_by_broadcast_and_by_shuffle(spark, monkeypatch, sent):
    monkeypatch.setattr(correlate, "SENT", sent)
    rng = random.Random(2)
    own = pd.DataFrame([(rng.randint(0, 3), x := rng.gauss(0, 1), x + rng.gauss(0, 1), 5) for _ in range(300)], columns=["a", "b", "c", "d"])
    got = {(r.col1, r.col2): r.value for r in correlate.correlation_matrix(spark.createDataFrame(own), method="spearman").collect()}
    want = own.rank().corr()
    for p in got:
        assert (got[p] is None and "d" in p) or abs(got[p] - want.loc[p]) < 1e-12


def test_rank_sums_need_no_moments(spark, monkeypatch):
    monkeypatch.setattr(correlate, "safe_corr", None)  # its code for many pairs is beyond what the JVM compiles
    frame = spark.createDataFrame([(float(k), float(k * k % 7)) for k in range(30)], "a double, b double")
    assert correlate.correlation_matrix(frame, method="spearman").count() == 4


def test_kth_least_is_exact(spark):
    rng = random.Random(4)
    x = [rng.choice([1.5, rng.expovariate(1) ** 9, 5e-324, 0.0]) for _ in range(700)]
    frame = spark.createDataFrame([(v,) for v in x], "d double")
    for k in (1, 100, 350, 699, 700):
        assert outliers.kth_least(frame, "d", k, 16) == sorted(x)[k - 1]


def test_long_partitions_are_spread(spark):
    frame = spark.range(1000).coalesce(1)
    assert lineage.spread(frame, 100).rdd.getNumPartitions() == 10 and lineage.spread(frame, 100).count() == 1000
    assert lineage.spread(frame, 1000).rdd.getNumPartitions() == 1
