"""Archives, kept datasets, loggers, named metrics and the robust covariance."""

import gzip
import importlib
import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrykit.functions import gibberish, patterns
from quarrykit.operators import matrix, outliers, scoring, stats
from quarrykit.sources import tabular


def test_single_gzip(tmp_path):
    with gzip.open(tmp_path / "words.txt.gz", "wb") as f:
        f.write(b"a 1\n")
    assert tabular.extract_missing(str(tmp_path / "words.txt.gz"), str(tmp_path / "out")) == ["words.txt"]
    assert (tmp_path / "out/words.txt").read_bytes() == b"a 1\n"
    assert tabular.extract_missing(str(tmp_path / "words.txt.gz"), str(tmp_path / "out")) == []


def test_archive_round_trip(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.txt").write_text("x")
    for kind in (".zip", ".tar", ".tar.gz"):
        made = tabular.make_archive(f"a{kind}", str(tmp_path / "in"), str(tmp_path))
        assert [n for n in tabular.extract_missing(made, str(tmp_path / f"o{kind}")) if n.endswith("x.txt")]
        with pytest.raises(FileExistsError):
            tabular.make_archive(f"a{kind}", str(tmp_path / "in"), str(tmp_path))


def test_catalogue_keeps_what_it_loaded(spark, tmp_path):
    (tmp_path / "w.txt").write_text("null 3\nword 2\n")
    c = tabular.Catalogue()
    c.register("words", str(tmp_path / "w.txt"), "word_counts")
    kept = c.load_kept(spark, "words", str(tmp_path / "kept"))
    assert sorted(map(tuple, kept.collect())) == [("null", 3), ("word", 2)]
    (tmp_path / "w.txt").unlink()
    assert c.load_kept(spark, "words", str(tmp_path / "kept")).count() == 2


def test_logger_has_one_handler_a_file(tmp_path):
    one, two = (tabular.logger("own", str(tmp_path), "l.txt") for _ in range(2))
    one.info("said")
    assert one is two and len([h for h in one.handlers if isinstance(h, logging.FileHandler)]) == 1
    assert "said" in (tmp_path / "l.txt").read_text()


def test_metrics_by_name(spark):
    rows = [(0.0, 0.0)] * 5 + [(0.0, 1.0)] * 2 + [(1.0, 1.0)] * 4 + [(2.0, 1.0)]
    df = spark.createDataFrame(rows, "label double, prediction double")
    get = lambda n, **a: scoring.MulticlassEvaluator(n, **a).evaluate(df)
    assert get("accuracy") == 9 / 12 and get("precision", of=1.0) == 4 / 7 and get("recall", of=0.0) == 5 / 7
    assert get("falsePositiveRate", of=1.0) == 3 / 8 and get("fMeasure", of=2.0) == 0
    assert abs(get("weightedRecall") - 9 / 12) < 1e-12
    p, r = 4 / 7, 1.0
    assert abs(get("fMeasure", of=1.0, beta=2.0) - 5 * p * r / (4 * p + r)) < 1e-12
    with pytest.raises(ValueError):
        get("unknown")


def test_robust_covariance_uses_all_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 2)) @ np.array([[2.0, 0.3], [0.0, 1.0]])
    x[:300] += 40
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(x)], "id bigint, a double, b double")
    for sample in (200, 5000):
        rows = {r.id: r.distance for r in outliers.mahalanobis_outliers(df, ["a", "b"], "id", threshold=None, sample=sample).collect()}
        if sample == 200:
            first = rows
    assert max(abs(first[k] - rows[k]) / (1 + rows[k]) for k in rows) < 0.05  # the sample only starts the search
    assert np.median([rows[k] for k in range(300)]) > 20 * np.median([rows[k] for k in range(300, 3000)])


def test_gibberish_is_linear_and_exact(spark):
    train = spark.createDataFrame([("the cat sat on the mat ",)] * 20, "text string")
    model = gibberish.GibberishDetector(smoothing=1.0).fit(train)
    texts = ["", "a", "The cat", "zq xj", "t" * 50_000, None, "Ünïcode the cat", "!!"]
    got = {r.text: r.probability for r in model.transform(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    own = gibberish.ACCEPTED
    counts = np.ones((len(own), len(own)))
    for a, b in zip("the cat sat on the mat ", "the cat sat on the mat "[1:]):
        counts[own.index(a), own.index(b)] += 20
    logs = np.log(counts / counts.sum(1, keepdims=True))
    for t in texts:
        w = [own.index(c) for c in (t or "").lower() if c in own]
        want = np.exp(np.mean([logs[a, b] for a, b in zip(w, w[1:])])) if len(w) > 1 else 1.0
        assert abs(got[t] - want) < 1e-9, t


def test_latex_refuses_rather_than_cuts(spark):
    df = spark.range(12)
    assert stats.to_latex(df, most=12).count("\\\\") == 13
    with pytest.raises(ValueError):
        stats.to_latex(df, most=11)


def test_blocks_follow_the_rows(spark):
    df = spark.range(50).withColumn("x", F.col("id") * 2)
    got = matrix.pairwise_difference(df, "id", "x")
    assert got.count() == 2500 and got.filter("v <> 2 * (j - i)").count() == 0
    assert "-" not in patterns.PATTERNS["special"] and "." not in patterns.PATTERNS["special"]


def test_entry_guard_hides_absence_only(monkeypatch):
    import builtins
    import sys

    real = builtins.__import__

    def broken(name, *args, **kw):
        if name == "quarrykit.llm" or name.startswith("quarrykit.llm."):
            raise ModuleNotFoundError(f"No module named {missing!r}", name=missing)
        return real(name, *args, **kw)

    monkeypatch.setattr(builtins, "__import__", broken)
    for missing, hidden in (("quarrykit.llm", True), ("xxhash", False)):
        sys.modules.pop("__spark_entry__", None)
        if hidden:
            e = importlib.import_module("__spark_entry__")
            assert "pipeline" not in e.queries() and "value_counts" in e.queries()
        else:
            with pytest.raises(ModuleNotFoundError):
                importlib.import_module("__spark_entry__")
    sys.modules.pop("__spark_entry__", None)
