"""Exact quantiles with linear interpolation, by one path at any table size and for any number of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from transferlens.functions.columns import is_missing
from transferlens.session import discard, materialise

ALL = "all"
# Brackets with more rows than this are narrowed down again before one task sorts what lies inside.
ROWS_PER_TASK = 1_000_000
# A sketch gives the values at these many even shares, each within 1/4000 of its share.
_STEPS, _ACCURACY = 500, 4_000


def long_values(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """(group, column, x): every value of the columns as a double, for group 'all' and for its value of ``by``.

    Missing values (null, NaN) are null here, so that a group without any value still has rows. Rows
    without a value of ``by`` count for 'all' only.
    """
    cells = [F.struct(F.lit(c).alias("column"), F.when(~is_missing(df, c), F.col(c).cast("double")).alias("x")) for c in columns]
    if by is None:
        return df.select(F.lit(ALL).alias("group"), F.inline(F.array(*cells)))
    groups = F.array_compact(F.array(F.lit(ALL), F.col(by).cast("string")))
    return df.select(groups.alias("groups"), F.inline(F.array(*cells))).select(F.explode("groups").alias("group"), "column", "x")


def quantile_table(long: DataFrame, probs: list[float], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(group, column, prob, value) of a table (group, column, x): one row per group, column and probability.

    A mergeable sketch per group and column serves all its probabilities: it brackets the two ranks that
    each quantile lies between. One pass then counts the values under each bracket and, by value, those
    inside, and a running sum picks the ranks. Brackets that still hold more than ``rows_per_task`` rows of
    different values are narrowed by sketches of what they hold first. Counts prove every bracket; an end
    that fails falls back to the proven one before. All state is tables keyed by (group, column, prob), so
    the plan does not grow with groups. Groups without values give null.
    """
    keys = ["group", "column", "prob"]
    seen = long.groupBy("group", "column").agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), _sketch(F.col("x")).alias("grid"))
    place = (F.col("n") - 1) * F.col("prob")
    wanted = seen.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs]))).withColumns(
        {"rank": F.floor(place) + 1, "rank_above": F.ceil(place) + 1, "part": place - F.floor(place), "below": F.lit(0).cast("long"), "inside": F.when(F.col("n") > 0, F.col("n"))}
    )
    brackets = _proved(long, wanted)
    while True:
        most = brackets.where("low < high").agg(F.max("inside")).first()[0] or 0
        if most <= rows_per_task:
            break
        held = _held(long, brackets).where("x >= low")
        grids = held.groupBy(*keys).agg(_sketch(F.col("x")).alias("grid"))
        narrower = _proved(long, brackets.join(grids, keys, "left"))
        done = (narrower.where("low < high").agg(F.max("inside")).first()[0] or 0) >= most
        discard(brackets)
        brackets = narrower
        if done:  # copies of few values fill the widest bracket: they are counted by value below
            break
    values = _held(long, brackets).where("x >= low").groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("rank", "rank_above", "part", "below")])
    upto = F.col("below") + F.sum("n").over(Window.partitionBy(*keys).orderBy("x"))
    ends = values.withColumn("upto", upto).groupBy(*keys, "part").agg(
        F.min(F.when(F.col("upto") >= F.col("rank"), F.col("x"))).alias("lower"), F.min(F.when(F.col("upto") >= F.col("rank_above"), F.col("x"))).alias("upper")
    )
    value = F.col("lower") + (F.col("upper") - F.col("lower")) * F.col("part")
    return brackets.select(*keys).join(ends, keys, "left").select(*keys, value.alias("value"))


def quantiles(df: DataFrame, columns: list[str], probs: list[float], by: str | None = None, rows_per_task: int = ROWS_PER_TASK) -> dict[tuple[str, str], list[float | None]]:
    """``{(group, column): [quantile, ...]}`` of ``quantile_table`` for callers that fit on a few groups, such as the label's."""
    found = {(ALL, c): [None] * len(probs) for c in columns}
    for r in quantile_table(long_values(df, columns, by), probs, rows_per_task).collect():
        values = found.setdefault((r["group"], r["column"]), [None] * len(probs))
        for i, p in enumerate(probs):
            if float(p) == r["prob"]:
                values[i] = r["value"]
    return found


def _sketch(x: Column) -> Column:
    return F.percentile_approx(x, F.array(*[F.lit(i / _STEPS) for i in range(_STEPS + 1)]), _ACCURACY)


def _held(long: DataFrame, brackets: DataFrame) -> DataFrame:
    """Each value up to its brackets' ends, once per bracket; a hot group is split by the join's skew handling or a broadcast."""
    return long.where("x IS NOT NULL").join(brackets.withColumnRenamed("n", "rows"), ["group", "column"]).where("x <= high")


def _proved(long: DataFrame, wanted: DataFrame) -> DataFrame:
    """Brackets narrowed to the steps of ``grid`` round their ranks, with counted rows under and inside them."""
    keys = ["group", "column", "prob"]
    slack = 2 / _ACCURACY

    def step(rank: str, sign: int) -> Column:
        share = (F.col(rank) - F.col("below")) / F.col("inside") + sign * slack
        return (F.floor((share - 1 / F.col("inside")) * _STEPS) if sign < 0 else F.ceil(share * _STEPS)).cast("int")

    near = F.when(step("rank", -1) > 0, F.get("grid", step("rank", -1))).otherwise(F.col("low"))
    far = F.when(step("rank_above", 1) < _STEPS, F.get("grid", step("rank_above", 1))).otherwise(F.col("high"))
    tried = wanted.withColumns({"from": near, "to": far}).drop("grid")
    tried = materialise(tried)
    counted = long.where("x IS NOT NULL").join(tried.select(*keys, "from", "to"), ["group", "column"])
    counts = counted.groupBy(*keys).agg(F.count_if(F.col("x") < F.col("from")).alias("under"), F.count_if(F.col("x") <= F.col("to")).alias("until"))
    low_holds, high_holds = F.col("under") < F.col("rank"), F.col("until") >= F.col("rank_above")
    proved = tried.join(counts, keys, "left").select(
        *keys, "n", "rank", "rank_above", "part",
        F.when(low_holds, F.col("from")).otherwise(F.col("low")).alias("low"),
        F.when(high_holds, F.col("to")).otherwise(F.col("high")).alias("high"),
        F.when(low_holds, F.col("under")).otherwise(F.col("below")).alias("below"),
        (F.when(high_holds, F.col("until")).otherwise(F.col("below") + F.col("inside")) - F.when(low_holds, F.col("under")).otherwise(F.col("below"))).alias("inside"),
    )
    proved = materialise(proved)
    discard(tried)
    return proved
