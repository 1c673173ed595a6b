"""Confusion counts, weighted scores, exact curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from transferlens.operators.ranking import running_totals, with_next
from transferlens.schema import LABEL
from transferlens.session import materialise

CELLS = ["tn", "fp", "fn", "tp"]


def confusion_counts(df: DataFrame, label: str = LABEL, prediction: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """One row per group with tn, fp, fn, tp: one pass, map-side combined."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    return df.groupBy(*(by or [])).agg(
        F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp")
    )


def confusion_cells(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Long form (actual, predicted, count), cells with zero included."""
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("count"))
            for a, p, c in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
        ]
    )
    return counts.select(*(by or []), F.explode(cells).alias("c")).select(*(by or []), "c.*")


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, 0.0).otherwise(top / bottom)


def class_scores(orientation: str = "standard") -> dict[int, dict[str, Column]]:
    """Precision, recall, F1 and support of both classes over the columns tn, fp, fn, tp.

    ``orientation='swapped'`` treats predictions as the truth and the truth as predictions.
    """
    tn, fp, fn, tp = (F.col(c) for c in CELLS)
    if orientation == "swapped":
        fp, fn = fn, fp
    elif orientation != "standard":
        raise ValueError("orientation is 'standard' or 'swapped'")
    out = {}
    for c, hit, missed, wrong in ((0, tn, fp, fn), (1, tp, fn, fp)):
        out[c] = {
            "precision": _ratio(hit, hit + wrong),
            "recall": _ratio(hit, hit + missed),
            "f1": _ratio(2 * hit, 2 * hit + missed + wrong),
            "support": hit + missed,
        }
    return out


def with_weighted_scores(counts: DataFrame, orientation: str = "standard") -> DataFrame:
    """Adds accuracy and support-weighted precision, recall and F1; 0 where undefined."""
    classes = class_scores(orientation)
    total = sum((F.col(c) for c in CELLS[1:]), F.col(CELLS[0]))
    weighted = {
        m: _ratio(sum((classes[c][m] * classes[c]["support"] for c in (1,)), classes[0][m] * classes[0]["support"]), total)
        for m in ("precision", "recall", "f1")
    }
    return counts.withColumns({**weighted, "accuracy": _ratio(F.col("tn") + F.col("tp"), total)})


def with_rates(counts: DataFrame) -> DataFrame:
    """Adds false- and true-positive rate; null where undefined."""
    return counts.withColumns(
        {
            "fpr": F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")),
            "tpr": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")),
        }
    )


def class_report(counts: DataFrame, by: list[str] | None = None, orientation: str = "standard") -> DataFrame:
    """One row per class plus macro and weighted averages."""
    classes = class_scores(orientation)
    names = ("precision", "recall", "f1")
    total = classes[0]["support"] + classes[1]["support"]
    rows = [F.struct(F.lit(str(c)).alias("class"), *[s[m].alias(m) for m in names], s["support"].alias("support")) for c, s in classes.items()]
    macro = [((classes[0][m] + classes[1][m]) / 2).alias(m) for m in names]
    weighted = [_ratio(sum((s[m] * s["support"] for s in list(classes.values())[1:]), classes[0][m] * classes[0]["support"]), total).alias(m) for m in names]
    rows.append(F.struct(F.lit("macro avg").alias("class"), *macro, total.alias("support")))
    rows.append(F.struct(F.lit("weighted avg").alias("class"), *weighted, total.alias("support")))
    return counts.select(*(by or []), F.explode(F.array(*rows)).alias("r")).select(*(by or []), "r.*")


def score_table(df: DataFrame, score: str = "score", label: str = LABEL, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Distinct scores with their positives and negatives, and both counted from the top score down."""
    grouped = df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    # Written once: counting, cutting into buckets and the totals then read groups, not the input again.
    return running_totals(materialise(grouped), "score", ["pos", "neg"], rows_per_bucket)


def _totals(table: DataFrame) -> tuple[int, int]:
    """Positives and negatives in all, from a score table."""
    return tuple(table.agg(F.coalesce(F.sum("pos"), F.lit(0)), F.coalesce(F.sum("neg"), F.lit(0))).first())


def roc_curve(df: DataFrame, score: str = "score", label: str = LABEL, rows_per_bucket: int = 1_000_000, drop_intermediate: bool = False) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, from (0, 0) at an infinite threshold.

    ``drop_intermediate`` leaves out scores after which both counts go on as they came, so that the point lies
    on the line between its neighbours; the highest and the lowest score stay.
    """
    table = score_table(df, score, label, rows_per_bucket)
    pos, neg = _totals(table)
    if drop_intermediate:
        table = with_next(table, "score", ["pos", "neg"], rows_per_bucket)
        first = (F.col("upto_pos") == F.col("pos")) & (F.col("upto_neg") == F.col("neg"))
        turns = (F.col("pos") != F.col("next_pos")) | (F.col("neg") != F.col("next_neg"))
        table = table.where(first | F.col("next_pos").isNull() | turns)
    points = table.select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("upto_neg"), F.lit(neg)).alias("fpr"),
        F.try_divide(F.col("upto_pos"), F.lit(pos)).alias("tpr"),
    )
    first = df.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(first)


def pr_curve(df: DataFrame, score: str = "score", label: str = LABEL, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """(threshold, precision, recall) per distinct score, ending at recall 0, precision 1."""
    table = score_table(df, score, label, rows_per_bucket)
    pos, _ = _totals(table)
    points = table.select(
        F.col("score").alias("threshold"),
        (F.col("upto_pos") / (F.col("upto_pos") + F.col("upto_neg"))).alias("precision"),
        F.try_divide(F.col("upto_pos"), F.lit(pos)).alias("recall"),
    )
    last = df.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(last)


def curve_areas(df: DataFrame, score: str = "score", label: str = LABEL, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Areas under both curves by trapezoids; null when only one class occurs.

    The point before a score follows from its running counts less its own, so no neighbour row is
    needed.
    """
    table = score_table(df, score, label, rows_per_bucket)
    up, un, pos, neg = (F.col(c).cast("double") for c in ("upto_pos", "upto_neg", "pos", "neg"))
    before = up - pos + un - neg
    precision = up / (up + un)
    precision_before = F.when(before == 0, 1.0).otherwise((up - pos) / before)
    sums = table.agg(
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
        F.sum(neg * (2 * up - pos) / 2).alias("roc"),
        F.sum(pos * (precision + precision_before) / 2).alias("pr"),
    )
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return sums.select(
        F.when(both, F.try_divide(F.col("roc"), F.col("p").cast("double") * F.col("n"))).alias("roc_auc"),
        F.when(both, F.try_divide(F.col("pr"), F.col("p").cast("double"))).alias("pr_auc"),
    )


def threshold_for_tpr(roc: DataFrame, target: float) -> DataFrame:
    """The curve point whose true-positive rate is closest to the target; ties: highest threshold. No row without positives."""
    point, order = F.struct(*roc.columns), F.struct(F.abs(F.col("tpr") - F.lit(target)), -F.col("threshold"))
    best = roc.where(F.col("tpr").isNotNull()).agg(F.min_by(point, order).alias("best"), F.max("tpr").alias("top"))
    return best.where("top > 0").select("best.*")


def choose_model(report: DataFrame, by: str = "recall", order: str = "model_no") -> DataFrame:
    """The report row with the best score; the first one listed wins ties."""
    return report.orderBy(F.desc(by), order).limit(1)
