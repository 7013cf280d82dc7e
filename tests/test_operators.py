import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrykit.functions import contractions, patterns, spelling, text
from quarrykit.functions.gibberish import GibberishDetector
from quarrykit.ml import params
from quarrykit.operators import cluster, columns, correlate, dedup, encode, matrix, outliers, profile, reshape, sampling, scoring, stats
from quarrykit.sources import tabular


@pytest.fixture(scope="module")
def gaps(spark):
    return spark.createDataFrame([(1, None, None, "x"), (2, 5, None, "y"), (3, 5, None, "x"), (4, 7, None, "x")], "id int, a int, b double, c string")


def test_missingness(gaps):
    assert {r.column: r.n_null for r in profile.missingness(gaps).collect()} == {"a": 1, "b": 4}
    assert {r.column: r.pct for r in profile.missingness_pct(gaps).collect()} == {"id": 0, "a": 25, "b": 100, "c": 0}
    assert columns.na_indicators(gaps).columns == ["id", "a", "a_NA", "b", "b_NA", "c"]


def test_constant_columns(spark, gaps):
    df = gaps.withColumn("k", F.lit(1.0))
    assert columns.drop_constant_columns(df).columns == ["id", "a", "b", "c"]
    assert columns.ColumnSelector(columns=["a", "b", "k"]).fit(df).transform(df).columns == ["a"]
    assert columns.ColumnSelector(columns=["a"], invert=True).fit(df).transform(df).columns == ["id", "c"]


def test_column_order(gaps):
    assert columns.reorder_columns(gaps, 0, 2).columns == ["a", "b", "id", "c"]
    assert columns.insert_column(gaps, "z", F.lit(0), before="b").columns == ["id", "a", "z", "b", "c"]
    assert columns.filter_columns(gaps, drop=["a", "c"], keep=["c"]).columns == ["c"]
    assert columns.filter_columns(gaps, drop=["a"]).columns == ["id", "b", "c"]


def test_empty_frame(spark, gaps):
    none = gaps.limit(0)
    assert [r.pct for r in profile.missingness_pct(none).collect()] == [None] * 4
    assert columns.drop_constant_columns(none).columns == none.columns
    assert profile.value_counts(none).count() == 0
    assert encode.scale(none, ["a"]).count() == 0
    assert tabular.empty_frame(spark).columns == []


def test_lists(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["p", "q"]), (2, [], []), (3, ["c"], ["r"])], "id int, l1 array<string>, l2 array<string>")
    out = reshape.explode_parallel_outer(df, ["l1", "l2"], fill="-").collect()
    assert sorted(map(tuple, out)) == [(1, "a", "p"), (1, "b", "q"), (2, "-", "-"), (3, "c", "r")]
    assert reshape.explode_parallel(df, "l1").count() == 3
    assert reshape.list_to_columns(df, "l1").columns[-2:] == ["l1_0", "l1_1"]
    assert {r.id: (r.a, r.b, r.c) for r in reshape.multi_hot(df, "id", "l1").collect()} == {1: (1, 1, 0), 3: (0, 0, 1)}


def test_unpivot_round_trip(gaps):
    long = reshape.melt(gaps, ["id"], ["a", "b"], as_string=True)
    assert long.count() == 8 and long.filter("value IS NULL").count() == 5


def test_rare_categories(spark):
    df = spark.createDataFrame([("a", "a", "a", "a"), ("b", "b", "a", "b"), ("a", "a", "a", "c"), ("b", "b", "a", "d"), ("c", "a", "a", "e")], "x1 string, x2 string, x3 string, x4 string")
    names = df.columns
    make = lambda ix: encode.RareCategoryIndexer(inputCols=names, outputCols=[f"ix_{c}" for c in names], threshold=0.25, returnIndexed=ix).fit(df).transform(df)
    got = make(True).collect()
    assert [[int(r[f"ix_{c}"]) for r in got] for c in names] == [[0, 1, 0, 1, 2], [0, 1, 0, 1, 0], [0] * 5, [0] * 5]
    assert [r.ix_x1 for r in make(False).collect()] == ["a", "b", "a", "b", "other"]
    assert {r.ix_x4 for r in make(False).collect()} == {"other"}


def test_label_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "label string")
    model = encode.LabelCoder().fit(df)
    assert [r[0] for r in model.transform(df).collect()] == [1, 0, 2]
    with pytest.raises(Exception, match="unseen"):
        model.transform(spark.createDataFrame([("z",)], "label string")).collect()


def test_scale(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)], "x double, k double")
    assert [round(r.x, 6) for r in encode.scale(df, ["x", "k"], "zscore").collect()] == [-1.224745, 0, 1.224745]
    assert {r.k for r in encode.scale(df, ["x", "k"]).collect()} == {0.0}


def test_top_categories(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), ("c",)], "v string")
    assert [r.v for r in encode.keep_top_categories(df, "v", 1).collect()] == ["Other", "a", "Other", "a", "Other", "Other"]


def test_unordered_dedup(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "b", "a"), (3, "ab", "c"), (4, "a", "bc")], "id int, x string, y string")
    assert sorted(r.id for r in dedup.drop_unordered_duplicates(df, ["x", "y"], ["id"]).collect()) == [1, 3, 4]


def test_row_counts(spark):
    df = spark.createDataFrame([([1, 2, 1],)], "a array<int>")
    assert df.select(dedup.counts_per_row(F.col("a"))).first()[0] == [2, 1, 0]


def test_sampling(spark):
    df = spark.createDataFrame([(i, "A" if i < 10 else "B" if i < 13 else "C") for i in range(14)], "id int, cls string")
    n = lambda **k: {r.cls: r["count"] for r in sampling.balanced_sample(df, "cls", "id", **k).groupBy("cls").count().collect()}
    assert n(n=3) == {"A": 3, "B": 3, "C": 3} and n(frac=1.0) == {"A": 1, "B": 1, "C": 1}
    with pytest.raises(TypeError):
        sampling.balanced_sample(df, "cls", "id")
    folds = sampling.stratified_folds(df, "cls", "id", 2).groupBy("cls", "fold").count().collect()
    assert sorted((r.cls, r.fold, r["count"]) for r in folds) == [("A", 0, 5), ("A", 1, 5), ("B", 0, 2), ("B", 1, 1), ("C", 0, 1)]


def test_correlation(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 20, 200)
    pdf = [(int(i), float(v), float(v * v), None if v % 5 == 0 else float(-v), 1.0) for i, v in enumerate(x)]
    df = spark.createDataFrame(pdf, "id int, x double, y double, z double, k double")
    import pandas as pd

    want = pd.DataFrame(pdf, columns=df.columns)[["x", "y", "z", "k"]]
    for method in ("pearson", "spearman"):
        got = {(r.col1, r.col2): r.value for r in correlate.correlation_matrix(df, ["x", "y", "z", "k"], method).collect()}
        if method == "pearson":
            m = want.corr()
            assert all(math.isclose(got[a, b], m.loc[a, b], abs_tol=1e-9) for a in "xyz" for b in "xyz")
        assert got["x", "k"] is None and round(got["x", "z"], 9) == -1
        if method == "spearman":
            assert round(got["x", "y"], 9) == 1
    reduced, report = correlate.select_uncorrelated(df, 0.5, ["x", "y", "k"])
    assert "y" not in reduced.columns and report.count() == 1


def test_matrix(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "a array<int>")
    cells = {(r.i, r.j): r.v for r in matrix.upper_matrix(df, "a").collect()}
    assert cells == {(0, 0): 1, (0, 1): 2, (1, 0): 0, (1, 1): 3}
    assert matrix.is_positive_definite(matrix.dense(spark, np.eye(3))) and not matrix.is_positive_definite(matrix.dense(spark, -np.eye(3)))
    rows = spark.createDataFrame([(0, [1, 2, 3]), (1, [1, 3, 1]), (2, [2, 2, 2])], "id int, a array<int>")
    got = {(r.i, r.j): r.v for r in matrix.hamming_pairs(rows, "id", "a").collect()}
    assert [[got[i, j] for j in range(3)] for i in range(3)] == [[0, 2, 2], [2, 0, 3], [2, 3, 0]]
    d = matrix.dense(spark, np.array([[0, 5, 1], [5, 0, 2], [1, 2, 0]], float))
    u = {(r.i, r.j): r.v for r in matrix.to_ultrametric(d).collect()}
    assert u[0, 1] == 2 and u[0, 0] == 1 and all(v <= w for v, w in ((u[0, 2], 1), (u[1, 2], 2)))


def test_scores(spark):
    df = spark.createDataFrame([([1, 2], [1, 1, 2]), ([], [1])], "t array<int>, p array<int>")
    got = [r[0] for r in df.select(scoring.average_precision(F.col("t"), F.col("p"), 3)).collect()]
    assert round(got[0], 4) == 0.8333 and got[1] is None
    b = spark.createDataFrame([(1, 1), (1, 0), (0, 0)], "label int, prediction int")
    r = scoring.binary_report(b).first()
    assert (r.tp, r.fn, r.tn, r.fp, r.recall, r.precision) == (1, 1, 1, 0, 0.5, 1.0)
    assert scoring.binary_report(b.filter("false")).first().accuracy == -1
    s = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)], "y int, s double")
    assert scoring.roc_auc(s, "y", "s").first()[0] == 0.625


def test_text(spark):
    df = spark.createDataFrame([("I can't go 'cause you'll shan't've",), ("Größe d'r",)], "t string")
    got = [r[0] for r in df.select(contractions.expand(F.col("t"))).collect()]
    assert got == ["i cannot go 'cause you you will shall not've", "größe d'r"]
    assert df.select(text.words(F.lit("Größe_1 été!"))).first()[0] == ["größe_1", "été"]
    assert df.select(patterns.extract(F.lit("at 09:30 pm or 23:59"), "time_of_day")).first()[0] == ["09:30 pm", "23:59"]
    b = spark.createDataFrame([([("I", "have"), ("have", "to"), ("to", "go")],), ([("the", "wi"), ("wi", "fi"), ("fi", "works")],), ([],)], "b array<struct<l:string,r:string>>")
    assert [r[0] for r in b.select(text.join_bigrams(F.col("b"), {"wi fi": "wifi"})).collect()] == ["I have to go", "the wifi works", ""]


def test_compounding(spark):
    df = spark.createDataFrame([("my wi fi works",)] * 3 + [("my wifi works",)] * 3, "t string")
    known = spark.createDataFrame([("wifi",), ("my",), ("works",)], "word string")
    assert {r.corrected for r in text.correct_compounding(df, "t", known).collect()} == {"my wifi works"}


def test_gibberish(spark):
    words = spark.createDataFrame([(f" {w} ",) for w in "natuur telefoon avond lijk fijn maak smaak lijken telefoneren natuurlijke avonden fijne telefoons".split()], "text string")
    model = GibberishDetector(smoothing=0.5).fit(words)
    score = spark.createDataFrame([("natuurlijk", 1), ("fijnavond", 1), ("smaakelijk", 1), ("telefoon", 1), ("adaefgr", 0), ("efsgtb rdrfw", 0), ("xqzvkw", 0), ("", 2)], "text string, good int")
    got = model.transform(score).collect()
    assert min(r.probability for r in got if r.good == 1) > max(r.probability for r in got if r.good == 0)
    assert [r.probability for r in got if r.good == 2] == [1.0]


def test_spelling(spark):
    d = spark.createDataFrame([("hello", 5), ("world", 3), ("été", 2)], "word string, count bigint")
    s = spark.createDataFrame([(1, ["helo", "wrold", "ete", "zzzzz"])], "id int, tokens array<string>")
    assert spelling.correct_sentences(s, "id", "tokens", d, 2).first().corrected == "hello world été zzzzz"
    assert "hello" in spark.range(1).select(spelling.edits_1(F.lit("helo"))).first()[0]
    assert spelling.fuzzy_correct(s, "id", "tokens", d, 75).first().corrected.startswith("hello world")


def test_tsv(spark, tmp_path, gaps):
    tabular.write_tsv(gaps, str(tmp_path / "t"))
    back = tabular.read_tsv(spark, str(tmp_path / "t"), gaps.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, gaps.collect()))
    with pytest.raises(ValueError):
        tabular.write_tsv(gaps.limit(0), str(tmp_path / "u"))
    (tmp_path / "w").write_text("null 5\nNA 3\n")
    assert [tuple(r) for r in tabular.read_word_counts(spark, str(tmp_path / "w")).collect()] == [("null", 5), ("NA", 3)]


def test_outliers_and_stats(spark):
    pts = [(-1, -1), (-2, -1), (-3, -2), (0, 0), (-20, 50), (3, 5), (1, 1), (2, 1), (0, 1), (1, 0)]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id int, a double, b double")
    assert [r.id for r in outliers.mahalanobis_outliers(df, ["a", "b"], "id").filter("outlier").collect()] == [4]
    assert stats.stars(0.005) == "***"
    with pytest.raises(ValueError):
        stats.stars(0.5, (0.1, 0.2))
    lev = stats.diagnostics(df, ["a"], "b", "id").agg(F.sum("leverage")).first()[0]
    assert round(lev, 6) == 2


def test_clusters(spark):
    x = [0.0, 0.1, 0.2, 5.0, 5.1, 5.2, 5.3]
    d = matrix.dense(spark, np.abs(np.subtract.outer(x, x)))
    ap = cluster.affinity_propagation(d.withColumn("v", -F.col("v")), rounds=100, damping=0.8).collect()
    groups = {}
    for r in ap:
        groups.setdefault(r.exemplar, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2], [3, 4, 5, 6]]
    for rounds in (1, 3):  # the distributed messages agree with the dense ones
        one, two = (sorted(map(tuple, cluster.affinity_propagation(d.withColumn("v", -F.col("v")), rounds=rounds, small=n).collect())) for n in (1000, 0))
        assert one == two
    h = {r.node: r.cluster for r in cluster.hdbscan(d, 3).collect()}
    assert len({h[0], h[1], h[2]}) == 1 and len({h[3], h[4], h[5], h[6]}) == 1 and h[0] != h[3]


def test_params(tmp_path):
    assert params.Converters.to_date("2020-01-02").year == 2020 and params.Converters.to_date((2020, 1, 2)).day == 2
    with pytest.raises(TypeError):
        params.Converters.to_date(3)
