import math

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from transferlens.operators import metrics

# Confusion counts [[p0a0, p0a1], [p1a0, p1a1]] (rows predicted) of known models with their scores
# when predictions are taken for the truth.
KNOWN = [
    ((9786, 12, 201, 1), 0.9616342306536959, 0.9787, 0.9694396431405047),
    ((9362, 4, 625, 9), 0.9218786098851584, 0.9371, 0.9079230021968008),
    ((9764, 12, 223, 1), 0.9574942194083078, 0.9765, 0.9661644786073622),
    ((39953, 2, 6, 39957), 0.9998999024050954, 0.9998998973948297, 0.9998998973950806),
    ((37731, 377, 2228, 39582), 0.9684769752932288, 0.9674040891914212, 0.9674215844264595),
    ((39251, 51, 708, 39908), 0.9906379325978477, 0.9905027653344678, 0.9905034072354595),
]
STANDARD = {0: (0.997483, 0.987960), 1: (0.998292, 0.966277), 2: (0.997480, 0.986836)}


@pytest.fixture(scope="module")
def known(spark):
    rows = [(i, tn, fp, fn, tp) for i, ((tn, fn, fp, tp), *_) in enumerate(KNOWN)]
    return spark.createDataFrame(rows, "i int, tn long, fp long, fn long, tp long")


def test_known_scores_swapped(known):
    got = {r["i"]: r for r in metrics.with_weighted_scores(known, "swapped").collect()}
    for i, (_, precision, recall, f1) in enumerate(KNOWN):
        assert math.isclose(got[i]["precision"], precision, rel_tol=1e-9)
        assert math.isclose(got[i]["recall"], recall, rel_tol=1e-9)
        assert math.isclose(got[i]["f1"], f1, rel_tol=1e-9)


def test_known_scores_standard(known):
    got = {r["i"]: r for r in metrics.with_weighted_scores(known).collect()}
    for i, (precision, f1) in STANDARD.items():
        assert abs(got[i]["precision"] - precision) < 1e-6 and abs(got[i]["f1"] - f1) < 1e-6
        assert got[i]["recall"] == got[i]["accuracy"]
    rates = {r["i"]: r["tpr"] for r in metrics.with_rates(known).collect()}
    assert [round(rates[i], 3) for i in range(3)] == [0.077, 0.692, 0.077]


def test_choice(known):
    report = metrics.with_weighted_scores(known.where("i < 3")).withColumn("model_no", F.col("i"))
    assert metrics.choose_model(report).first()["i"] == 0


def _scores(spark, rows):
    return spark.createDataFrame(rows, "score double, is_laundering int")


def test_tied_top_score(spark):
    df = _scores(spark, [(0.9, 0), (0.9, 1), (0.7, 1), (0.2, 0)])
    areas = metrics.curve_areas(df).first()
    assert math.isclose(areas["pr_auc"], 2 / 3, rel_tol=1e-12)
    assert math.isclose(areas["roc_auc"], 0.625, rel_tol=1e-12)
    assert (math.inf, 1.0, 0.0) in [tuple(r) for r in metrics.pr_curve(df).collect()]
    assert (math.inf, 0.0, 0.0) in [tuple(r) for r in metrics.roc_curve(df).collect()]


def test_one_class_has_no_area(spark):
    areas = metrics.curve_areas(_scores(spark, [(0.9, 1), (0.1, 1)])).first()
    assert areas["roc_auc"] is None and areas["pr_auc"] is None


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 50])
def test_roc_area_equals_evaluator(transfer_rows, rows_per_bucket):
    df = transfer_rows.select((F.col("amount_received") / 2e5).alias("score"), "is_laundering")
    area = metrics.curve_areas(df, rows_per_bucket=rows_per_bucket).first()["roc_auc"]
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="is_laundering", numBins=0)
    assert math.isclose(area, evaluator.evaluate(df), rel_tol=1e-9)


def test_threshold(spark):
    df = _scores(spark, [(i / 100, int(i % 3 == 0)) for i in range(100)])
    row = metrics.threshold_for_tpr(metrics.roc_curve(df), 0.5).first()
    assert row["tpr"] == 0.5


def test_no_predicted_positives(spark):
    counts = spark.createDataFrame([(5, 0, 2, 0)], "tn long, fp long, fn long, tp long")
    report = {r["class"]: r for r in metrics.class_report(counts).collect()}
    assert report["1"]["precision"] == 0.0 and report["1"]["support"] == 2
    assert metrics.with_rates(spark.createDataFrame([(0, 0, 2, 0)], "tn long, fp long, fn long, tp long")).first()["fpr"] is None


def test_roc_curve_without_points_on_a_line(spark):
    rng = np.random.default_rng(8)
    score = np.round(rng.random(400), 3)
    label = (rng.random(400) < score).astype(int)
    label[score > 0.9] = 1
    df = spark.createDataFrame(list(zip(score.tolist(), label.tolist())), "score double, is_laundering int")
    order = np.unique(score)[::-1]
    tps = np.cumsum([label[score == s].sum() for s in order])
    fps = np.cumsum([(1 - label[score == s]).sum() for s in order])
    keep = np.r_[True, (np.diff(fps, 2) != 0) | (np.diff(tps, 2) != 0), True]
    expected = [(float(s), f / fps[-1], t / tps[-1]) for s, f, t, k in zip(order, fps, tps, keep) if k]
    for rows_per_bucket in (1_000_000, 17):
        got = metrics.roc_curve(df, rows_per_bucket=rows_per_bucket, drop_intermediate=True).where("threshold < 2").orderBy(F.desc("threshold")).collect()
        assert len(got) == len(expected) < len(order) and np.allclose([tuple(r) for r in got], expected)
