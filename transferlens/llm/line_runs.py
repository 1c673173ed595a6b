"""Line dedup by names of neighbouring lines, without a suffix array; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transferlens.llm.common import bucketed, shards
from transferlens.session import discard, materialise


def names_by_doubling(ids: Column, length: int) -> Column:
    """Per line, the name of the ``length`` lines from it on; null where fewer are left.

    Prefix doubling: names of 2k lines are hashes of two names of k lines, k apart. A length between
    two powers takes two overlapping names.
    """
    names, k = ids, 1
    while 2 * k <= length:
        names = _joined(names, k)
        k *= 2
    return _joined(names, length - k) if length > k else names


def _joined(names: Column, apart: int) -> Column:
    rest = F.greatest(F.size(names) - apart, F.lit(0))
    return F.zip_with(F.slice(names, F.lit(1), rest), F.slice(names, F.lit(apart + 1), rest), lambda a, b: F.xxhash64(a, b))


def remove_later_runs(docs: DataFrame, keep: list[str] | None = None, min_lines: int = 2, long_line: int | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Deletes every line covered by a run of ``min_lines`` lines, or (if given) one line of ``long_line`` characters, that also starts earlier.

    "Earlier" is a smaller id, or an earlier line of the same row. Each place of a row is named by a hash
    of the ``min_lines`` lines from it on (``names_by_doubling``, inside the row), and long lines by one of
    their own; neither a suffix order nor common prefixes are computed. Of each group of equal names the
    first place stays and the rest mark their lines; neighbouring marks join into runs. A longer run is
    the union of its shortest ones, so deeper names would delete the same lines. A repeated run of fewer
    than ``min_lines`` lines, none of them long, stays, also when it is a whole text.

    Lines end at "\\n"; runs of blank lines only do not count. Rows with equal ids are ordered by text;
    rows that are equal in both stand side by side, so each is earlier or later in a fixed sense of the
    table that is written first. A null id comes first. A null text stays null; empty tables give empty
    results. Returns ``keep`` (default: all columns) with the new text, n_lines, n_removed and n_runs, as
    a written table. Texts are laid out by row number, so none is shuffled; what lies between is deleted.
    """
    keep = docs.columns if keep is None else keep
    rows = docs.select(*keep).withColumn("_row", F.monotonically_increasing_id())
    lines = F.split(F.col(text), "\n", -1)
    with bucketed(rows, "_row", shards(docs.sparkSession)) as laid:  # row numbers are fixed from here on
        spots = materialise(_spots(laid.where(F.col(text).isNotNull()), lines, min_lines, long_line, id))
        place = F.struct(F.col("doc").isNotNull().alias("known"), "doc", "_row", "at")
        first = spots.groupBy("width", "name").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        later = spots.join(first, ["width", "name"]).where(place > F.col("first")).select("_row", "at", "width")
        # at most a row's own lines, twice
        marks = later.groupBy("_row").agg(F.collect_list(F.sequence("at", F.col("at") + F.col("width") - 1)).alias("p"))
        marks = marks.withColumn("p", F.array_sort(F.array_distinct(F.flatten("p"))))
        begin = F.filter("p", lambda x, i: (i == 0) | (x - F.get("p", i - 1) > 1))
        end = F.transform(F.filter("p", lambda x, i: (i == F.size("p") - 1) | (F.get("p", i + 1) - x > 1)), lambda x: x + 1)
        runs = marks.select(F.col("_row").alias("_marked"), begin.alias("_begin"), end.alias("_end"))
        joined = laid.join(runs, laid["_row"] == runs["_marked"], "left").withColumn("_lines", lines)
        after = F.concat(F.array(F.lit(0)), "_end")
        upto = F.concat("_begin", F.array(F.size("_lines")))
        kept = F.flatten(F.zip_with(after, upto, lambda a, b: F.slice("_lines", a + 1, b - a)))
        removed = F.aggregate(F.zip_with("_begin", "_end", lambda a, b: b - a), F.lit(0), lambda s, x: s + x)
        cut = F.col("_begin").isNotNull()
        new_text = F.when(cut, F.array_join(kept, "\n")).otherwise(F.col(text))
        result = materialise(joined.select(
            *[new_text.alias(text) if c == text else F.col(c) for c in keep],
            F.when(F.col(text).isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
            F.when(cut, removed).otherwise(0).cast("long").alias("n_removed"),
            F.when(cut, F.size("_begin")).otherwise(0).cast("long").alias("n_runs"),
        ))
        discard(spots)
    return result


def _spots(rows: DataFrame, lines: Column, min_lines: int, long_line: int | None, id: str) -> DataFrame:
    """(doc, _row, at, width, name): the runs of ``width`` lines from line ``at`` on that would count if they stood earlier."""
    ids = F.transform(lines, lambda x: F.when(F.trim(x) == "", F.lit(None).cast("long")).otherwise(F.xxhash64(x)))
    # a blank line has a name of its own; the second list tells the runs that are blank throughout
    named = F.transform(ids, lambda x: F.coalesce(x, F.lit(0).cast("long")))
    filled = F.transform(ids, lambda x: x.isNotNull())
    for k in range(1, min_lines):  # whether any line of a run is filled
        filled = F.zip_with(filled, F.slice(filled, F.lit(2), F.greatest(F.size(filled) - 1, F.lit(0))), lambda a, b: a | F.coalesce(b, F.lit(False)))
    runs = F.zip_with(names_by_doubling(named, min_lines), filled, lambda name, full: F.when(full, name))
    if long_line is None:
        names = F.transform(runs, lambda a: F.struct(a.alias("run"), F.lit(None).cast("long").alias("line")))
    else:
        longs = F.zip_with(lines, ids, lambda x, i: F.when(F.length(x) >= long_line, i))
        names = F.zip_with(runs, longs, lambda a, b: F.struct(a.alias("run"), b.alias("line")))
    spots = rows.select(F.col(id).alias("doc"), "_row", F.posexplode(names).alias("at", "n"))
    both = F.array(F.struct(F.lit(min_lines).alias("width"), F.col("n.run").alias("name")), F.struct(F.lit(1).alias("width"), F.col("n.line").alias("name")))
    return spots.select("doc", "_row", "at", F.inline(both)).where("name IS NOT NULL")
