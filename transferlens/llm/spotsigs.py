"""SpotSigs: chains of content words after common-word anchors. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transferlens.llm.common import cuts, part_of, shards
from transferlens.session import materialise

#: Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their "
    "they this to was we were what when which who will with would you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous ou par pas pour qu que qui "
    "sa se ses son sur un une vous "
    "als am auch auf aus bei das dem den der die durch ein eine einer er es für haben hat ich im ist mit nach nicht noch "
    "sich sie sind so und vom von war wie wir zu zum zur über "
    "al como con del el ella era esta este fue ha las lo los más no o para pero por se sin sobre su sus una uno y ya"
).split()


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def with_signatures(df: DataFrame, text: str, to: str, anchors: list[str] | None = None, chain: int = 2, distance: int = 1) -> DataFrame:
    """Adds the sorted distinct 32-bit signatures of ``text``.

    A signature is an anchor with the ``chain`` content words (words that are no anchors) that follow
    it, ``distance`` content words apart; near the end of a text the chain is shorter. A text without
    any gets one signature of all its words, so equal texts have equal signatures and none is empty;
    null counts as empty.
    """
    anchors = list(dict.fromkeys(ANCHORS if anchors is None else anchors))
    words = df.withColumn("_w", _words(F.coalesce(F.col(text), F.lit(""))))
    content = F.filter(F.transform("_w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda e: ~e["x"].isin(anchors))
    spots = words.withColumn("_c", content)

    def signatures(e: Column, k: Column) -> Column:
        before = F.coalesce(F.get("_c", k - 1)["i"], F.lit(-1))
        tail = [F.get("_c", k + j * distance)["x"] for j in range(1, chain)]
        return F.transform(F.slice("_w", before + 2, e["i"] - before - 1), lambda a: F.hash(a, e["x"], *[F.coalesce(t, F.lit("")) for t in tail]))

    found = F.array_sort(F.array_distinct(F.flatten(F.transform("_c", signatures))))
    spots = spots.withColumn(to, found)
    whole = F.array(F.hash(F.array_join("_w", " ")))
    return spots.withColumn(to, F.when(F.size(to) > 0, F.col(to)).otherwise(whole)).drop("_w", "_c")


def printed(signatures: Column) -> Column:
    """Signatures as one string of 8 hex digits each."""
    return F.array_join(F.transform(signatures, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two signature sets."""
    both = F.size(F.array_intersect(a, b))
    return (both / (F.size(a) + F.size(b) - both)).cast("double")


def length_part(size: Column, threshold: float) -> Column:
    """Part of a set by its size; sets two parts apart cannot reach the threshold."""
    return F.floor(F.log(size.cast("double")) / F.lit(math.log(1 / threshold)) + F.lit(1e-9)).cast("int")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, likeness) of class representatives that reach the threshold, and members (id, class).

    A class holds the documents of one signature set; its representative is the smallest id (null ids
    are left out of both results). Sets are dealt by length parts; in a part only sets that share one
    of their rarest signatures meet, since a set of n that reaches the threshold must share one of its
    n - ceil(threshold * n) + 1 rarest. Meeting pairs are dropped by size before Jaccard is computed.
    """
    sets = materialise(with_signatures(docs.select(id, text).where(F.col(id).isNotNull()), text, "s").select(id, "s"))
    classes = materialise(sets.groupBy("s").agg(F.min(id).alias("class")))
    members = sets.join(classes, "s").select(id, "class")
    rows = classes.select("class", F.explode("s").alias("sig"))
    ranked = rows.join(rows.groupBy("sig").count(), "sig")
    n = F.size("order")
    order = ranked.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("count", "sig"))).alias("order"))
    rare = order.select("class", n.alias("n"), F.explode(F.slice("order", F.lit(1), n - F.ceil(n * threshold - 1e-9).cast("int") + 1)).alias("e"))
    rare = materialise(rare.select("class", "n", length_part(F.col("n"), threshold).alias("part"), F.col("e.sig").alias("sig")))
    probe = rare.select(F.col("class").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    index = rare.select(F.col("class").alias("b"), F.col("n").alias("nb"), "sig", "part")
    close = (F.col("nb") >= F.col("na")) & (F.col("na") >= F.col("nb") * threshold - 1e-9) & ((F.col("na") < F.col("nb")) | (F.col("a") < F.col("b")))
    met = probe.join(index, ["sig", "part"]).where(close).select("a", "b").distinct()
    left, right = classes.select(F.col("class").alias("a"), F.col("s").alias("sa")), classes.select(F.col("class").alias("b"), F.col("s").alias("sb"))
    pairs = met.join(left, "a").join(right, "b").select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness"))
    return pairs.where(F.col("likeness") >= threshold - 1e-9).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness"), members


def with_next(df: DataFrame, id: str, columns: list[str]) -> DataFrame:
    """Adds ``next_<column>`` of the row with the next greater id; the last row gets the first one's.

    Rows with equal ids follow each other in the order of ``columns``; a null id comes first. Rows are
    dealt into ranges of ids, and the first row of each range is also sent to the range before it, so
    no window spans the table.
    """
    bounds = cuts(df.select(id), id, shards(df.sparkSession))
    place = part_of(F.col(id), bounds)
    least = df.select(place.alias("p"), F.struct(F.col(id).isNotNull().alias("known"), F.col(id).alias("id")).alias("k")).groupBy("p").agg(F.min("k").alias("k"))
    firsts = sorted((r["p"], r["k"]["id"]) for r in least.collect())  # a row per range
    copy = [(firsts[i - 1][0], p, first) for i, (p, first) in enumerate(firsts)]
    if not copy:
        return df.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    before, starts = [0] * (len(bounds) + 1), [None] * (len(bounds) + 1)
    for to, p, first in copy:
        before[p], starts[p] = to, first
    kind = df.schema[id].dataType
    start = F.get(F.array(*[F.lit(s).cast(kind) for s in starts]), F.col("_p"))
    own = F.struct(F.col("_p").alias("p"), F.lit(False).alias("late"))
    also = F.struct(F.get(F.lit(before), F.col("_p")).alias("p"), F.lit(True).alias("late"))
    dealt = df.withColumn("_p", place).withColumn("_at", F.explode(F.when(F.col(id).eqNullSafe(start), F.array(own, also)).otherwise(F.array(own))))
    dealt = dealt.select(*df.columns, F.col("_at.p").alias("_part"), F.col("_at.late").alias("_late"))
    window = Window.partitionBy("_part").orderBy("_late", id, *columns)
    following = dealt.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in columns])  # one window, one exchange
    return following.where("NOT _late").drop("_part", "_late")
