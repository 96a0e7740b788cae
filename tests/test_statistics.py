"""Quantiles, resampling and neighbours against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ophelion.operators import classify, cluster, quantiles, reports, scores
from ophelion.plans import catalogue


def nearest(x, q):
    x = np.sort(x)
    return x[int(np.floor(q * (len(x) - 1) + 0.5))]


@pytest.mark.parametrize("kind", ["tail", "few", "narrow"])
def test_quantiles_of_large_and_small_groups(spark, kind):
    rng = np.random.default_rng(3)
    n = 60_000
    values = {"tail": np.exp(rng.normal(0, 6, n)), "few": rng.integers(0, 5, n).astype(float), "narrow": 1e6 + rng.random(n)}[kind]
    groups = np.where(rng.random(n) < 0.9, "big", "small")
    rows = [(str(g), float(v)) for g, v in zip(groups, values, strict=True)] + [("big", None), ("none", None), (None, 3.0), (None, 9.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    shares = {"a": 0.025, "b": 0.5, "c": 0.9999, "d": 0.0, "e": 1.0}
    linear = {r["g"]: [r[c] for c in shares] for r in quantiles.quantiles(df, "v", shares, ["g"]).collect()}
    close = {r["g"]: [r[c] for c in shares] for r in quantiles.quantiles(df, "v", shares, ["g"], nearest=True).collect()}
    assert set(linear) == set(close) == {"big", "small", None}
    for g in ("big", "small"):
        x = values[groups == g]
        assert linear[g] == pytest.approx(list(np.quantile(x, list(shares.values()))), rel=1e-12)
        assert close[g] == [nearest(x, q) for q in shares.values()]
    assert linear[None][1] == 6.0
    assert reports.upper_median_of(df, "v").first()["median"] == np.sort(np.append(values, [3.0, 9.0]))[(n + 2) // 2]


def test_quantiles_without_rows(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert quantiles.quantiles(empty, "v", {"a": 0.5}, ["g"]).count() == 0
    assert reports.upper_median_of(empty, "v").first()["median"] is None
    assert scores.descriptive_stats(empty, "v").first().asDict() == {"mean": 0.0, "sd": 0.0, "mode": 0.0, "median": 0.0, "iqr": 0.0, "min": 0.0, "max": 0.0, "n": 0}
    assert cluster.describe(empty, "v", ["g"]).columns == ["g", "count", "mean", "std", "min", "p25", "p50", "p75", "p90", "p95", "max"]


def test_nearest_rows_in_blocks(spark):
    x = np.random.default_rng(5).normal(size=(90, 3)).round(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    found = {r["id"]: r["near"] for r in classify.nearest_rows(df, "id", "x", 4, block_rows=20).collect()}
    for i, v in enumerate(x):
        d = ((x - v) ** 2).sum(axis=1)
        d[i] = np.inf
        assert d[found[i]] == pytest.approx(np.sort(d)[:4])


def test_smote_lies_between_neighbours(spark):
    x = np.random.default_rng(6).normal(size=(100, 2))
    df = spark.createDataFrame([(i, int(i < 12), v.tolist()) for i, v in enumerate(x)], "id long, y int, x array<double>")
    out = classify.smote(df, "y", "id", "x", k=3).collect()
    made = np.array([r["x"] for r in out if r["synthetic"]])
    assert len(out) == 176 and len(made) == 76
    for m in made:  # on the segment from a row to one of its three nearest
        best = np.inf
        for i in range(12):
            d = ((x[:12] - x[i]) ** 2).sum(axis=1)
            d[i] = np.inf
            for j in np.argsort(d)[:3]:
                best = min(best, abs(np.linalg.norm(m - x[i]) + np.linalg.norm(m - x[j]) - np.linalg.norm(x[i] - x[j])))
        assert best < 1e-9
    balanced = df.where("id < 24")
    assert classify.smote(balanced, "y", "id", "x").count() == 24


def test_dealt_keeps_rows_and_values(spark):
    df = spark.range(500).withColumn("v", F.col("id") * 3)
    out = classify.dealt(df, "v", "id", 1, group_rows=100).collect()
    assert sorted(r["id"] for r in out) == list(range(500)) and sorted(r["v"] for r in out) == [3 * i for i in range(500)]
    assert sum(r["v"] == 3 * r["id"] for r in out) < 50


def test_permutation_test(spark):
    df = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "id long, y int, p int")
    score = lambda rows: classify.binary_metrics(rows, "y", "p").first()["balanced_accuracy"]
    row = classify.permutation_test(df, score, "y", "id", replicates=9).first()
    assert row.asDict() == {"observed": 1.0, "replicates": 9, "at_least": 0, "p_value": 0.1}


def test_bootstrap_balanced_accuracy(spark):
    rng = np.random.default_rng(8)
    y, p = rng.integers(0, 2, 300), rng.integers(0, 2, 300)
    p[:200] = y[:200]
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(y, p, strict=True)] + [(None, 1)], "y int, p int")
    row = classify.bootstrap_balanced_accuracy(df, "y", "p").first()
    ba = lambda a, b: (np.mean(b[a == 1] == 1) + np.mean(b[a == 0] == 0)) / 2
    draws = [ba(y[i], p[i]) for i in rng.integers(0, 300, (4000, 300))]
    assert row["balanced_accuracy"] == pytest.approx(ba(y, p)) and row["n"] == 300
    assert [row["low"], row["high"]] == pytest.approx(list(np.quantile(draws, [0.025, 0.975])), abs=0.01)
    assert classify.bootstrap_balanced_accuracy(df.limit(0), "y", "p").first()["n"] == 0


def test_impurity_importance_and_kinds_of_nested_cv(spark):
    from pyspark.ml.classification import DecisionTreeClassifier

    rows = [(i, float(i % 3), float(i % 3 == 1), float(i % 3) + 0.01 * (i % 7), float(i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, y double, z double, a double, b double").persist()
    tree = DecisionTreeClassifier(maxDepth=3, seed=1)
    ready = classify.preprocessing(["a", "b"], []).fit(df)
    model = tree.copy({tree.labelCol: "y", tree.featuresCol: "features"}).fit(ready.transform(df))
    got = {r["feature"]: r["importance"] for r in classify.mdi_importance(spark, model, ["a_imp", "b_imp"], ["a", "b"]).collect()}
    assert got["a"] == pytest.approx(1.0) and got["b"] == pytest.approx(0.0)
    with pytest.raises(ValueError):
        classify.mdi_importance(spark, model, ["a"], ["a"])
    several = classify.nested_cv(df, {"t": tree}, "y", "id", ["a", "b"], outer=2, multiclass=True).collect()
    assert [r["balanced_accuracy"] for r in several] == [1.0, 1.0]
    both = classify.nested_cv_multilabel(df.withColumn("w", F.col("z") == 0), {"t": tree}, ["z", "w"], "id", ["a", "b"], outer=2).collect()
    assert [(r["label"], r["balanced_accuracy"]) for r in both] == [("z", 1.0)] * 2 + [("w", 1.0)] * 2


def test_nemenyi_leaves_out_blocks_that_lack_a_treatment(spark):
    rows = [(b, t, float(v)) for b, vs in enumerate([(1, 2, 3), (3, 2, 1), (1, 3, 2)]) for t, v in zip("xyz", vs, strict=True)] + [(9, "x", 50.0)]
    df = spark.createDataFrame(rows, "b int, t string, v double")
    got = {(r["treatment_a"], r["treatment_b"]): r["mean_rank_gap"] for r in scores.nemenyi(df, "b", "t", "v").collect()}
    assert got == pytest.approx({("x", "y"): 2 / 3, ("x", "z"): 1 / 3, ("y", "z"): 1 / 3})


@pytest.mark.parametrize("name", ["likert_scores", "answer_scores", "subscale_scores"])
def test_answers_are_scored_in_one_pass(spark, name):
    """The answers are not joined with their own totals."""
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey#") > 0 and plan.count("Relation [l_orderkey") == 1


def test_scores_of_repeated_and_nameless_answers(spark):
    """Of repeated answers each has a row with the total of all; unknown options, none and a
    missing submission score 0."""
    given = [(1, 1, [10, 11]), (1, 1, [11]), (1, 2, []), (1, 2, [99]), (2, 1, [99, 11, 10]), (2, 2, None), (None, 1, [11]), (3, 7, [10])]
    answers = spark.createDataFrame(given, "submission_id long, question_id long, selected_options array<long>")
    options = spark.createDataFrame([(1, 10, 0, 1.0), (1, 11, 1, 2.0), (2, 20, 0, 4.0)], "question_id long, option_id long, sort_order int, weight double")
    kinds = spark.createDataFrame([(1, "single"), (2, "multiple")], "question_id long, question_type string")
    key = lambda rows: sorted(map(tuple, rows), key=repr)
    assert key(scores.score_by_sum(answers, options).collect()) == key([(1, 1, 5.0), (1, 2, 0.0), (2, 1, 3.0), (2, 2, 0.0), (None, 1, 0.0), (3, 7, 0.0)])
    typed = scores.score_by_type(spark.createDataFrame(given[1:], answers.schema), options, kinds).collect()
    assert key(typed) == key([(1, 1, 2.0), (1, 2, 0.0), (1, 2, 0.0), (2, 1, 2.0), (2, 2, 0.0), (None, 1, 0.0)])
    both = scores.score_by_type(answers.where("submission_id = 1"), options, kinds.withColumn("question_type", F.lit("multiple"))).collect()
    assert key(both) == key([(1, 1, 5.0)] * 2 + [(1, 2, 0.0)] * 2)


def test_feature_importance_computes_text_features_once(spark, monkeypatch):
    from ophelion.plans import catalogue

    names, keep = [], catalogue.staged
    monkeypatch.setattr(catalogue, "staged", lambda df, name: names.append(name) or keep(df, name))
    got = {r["feature"]: r["importance"] for r in catalogue.QUERIES["feature_importance"](spark, "/root/testdata/sf0.001").collect()}
    assert names == ["features"] and set(got) == {"words", "sentences", "syllables", "letters"}


def test_values_are_dealt_over_all_rows(spark):
    """Each deal is a permutation of all rows, whatever the ranges, and deals differ."""
    df = spark.createDataFrame([(i, float(i), None if i % 9 == 0 else i, i % 2) for i in range(400)], "k long, a double, b long, y int")
    got = classify.deals(df, ["a", "b"], "k", 3, 1, group_rows=40).toPandas()
    assert len(got) == 400 * 6 and list(got.columns) == ["_feature", "_repeat", "k", "a", "b", "y"]
    seen = set()
    for (feature, _), part in got.groupby(["_feature", "_repeat"]):
        part = part.sort_values("k")
        assert part["k"].tolist() == list(range(400)) and part["y"].tolist() == [i % 2 for i in range(400)]
        assert sorted(part["a"]) == [float(i) for i in range(400)] and part["b"].isna().sum() == 45
        moved, kept = (part["a"], part["b"]) if feature == "a" else (part["b"], part["a"])
        assert [x for x in kept if x == x] == [i for i in range(400) if feature == "b" or i % 9]
        seen.add(tuple(moved.fillna(-1)))
        assert abs(np.corrcoef(np.arange(400), moved.fillna(200))[0, 1]) < 0.25
    assert len(seen) == 6
    one = classify.dealt(df, "a", "k", 5, group_rows=40).toPandas().sort_values("k")["a"].tolist()
    assert sorted(one) == [float(i) for i in range(400)] and abs(np.corrcoef(np.arange(400), one)[0, 1]) < 0.25


def test_permutation_importance_is_of_ten_deals(spark):
    """A model that repeats one column: the mean and sd of the falls in accuracy, for labels
    of unequal classes; the column without use falls by nothing."""

    class Repeats:
        def transform(self, rows):
            seen.append(rows)
            return rows.withColumn("prediction", F.col("a"))

    seen = []
    df = spark.createDataFrame([(i, float(i % 4 == 0), float(i % 3), float(i % 4 == 0)) for i in range(600)], "k long, a double, b double, y double")
    got = classify.permutation_importance(Repeats(), df, ["b", "a"], "y", "k").collect()
    assert [r["feature"] for r in got] == ["a", "b"] and tuple(got[1])[1:] == (0.0, 0.0)
    wrong = seen[1].where("_feature = 'a'").groupBy("_repeat").agg(F.avg((F.col("a") != F.col("y")).cast("double")).alias("w")).toPandas()["w"]
    assert len(wrong) == 10
    assert (got[0]["importance"], got[0]["importance_std"]) == pytest.approx((wrong.mean(), wrong.std(ddof=0)))
    assert got[0]["importance"] == pytest.approx(2 * 0.25 * 0.75, abs=0.05)


def test_long_export_gathers_no_answers(spark):
    """Texts in the order selected; answers aren't exploded and gathered again."""
    from ophelion.operators import reports

    subs = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "submission_id long, submitted_at string, total_score double")
    qs = spark.createDataFrame([(1, "Q1"), (2, "Q2")], "question_id long, caption string")
    opts = spark.createDataFrame([(1, 10, "x"), (1, 11, "y"), (1, 12, None)], "question_id long, option_id long, text string")
    ans = spark.createDataFrame([(1, 1, [11, 10, 12, 99], "t", 1.0), (1, 2, [10], None, None), (2, 1, None, None, 0.0), (2, 2, [], "u", 0.0)], "submission_id long, question_id long, selected_options array<long>, text_response string, score double")
    found = reports.long_export(subs, ans, qs, opts)
    assert {(r["submission_id"], r["question_id"]): r["options"] for r in found.collect()} == {(1, 1): "y; x", (1, 2): "", (2, 1): "", (2, 2): ""}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "Aggregate [submission_id" not in plan
