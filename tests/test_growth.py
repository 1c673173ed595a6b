"""What grows with the rows: written blocks, shuffled lines, copies per subset, training rows that a query has no use for."""

import pyarrow.parquet as pq
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from transferlens import session
from transferlens.operators import sampling
from transferlens.operators.splits import blocks_of, pack, released
from transferlens.plans import model_queries
from transferlens.sources.transfers import derive_transfers


def test_blocks_are_written_in_small_groups_and_not_cached(spark):
    rows = spark.range(0, 180_000, 1, 1)
    df = rows.select(array_to_vector(F.array(F.col("id").cast("double"))).alias("features"), (F.col("id") % 2).alias("label"))
    data = pack(df, "features", "label")
    groups = []
    for file in data.written.inputFiles():
        meta = pq.ParquetFile(file.removeprefix("file://")).metadata
        groups += [meta.row_group(i).num_rows for i in range(meta.num_row_groups)]
    assert sum(groups) == 18 and max(groups) <= 16
    assert not data.blocks.is_cached
    released(data)


def test_orders_meet_customers_before_the_lines(spark):
    plan = derive_transfers(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "Join" in line and "o_custkey" in line.split("Join")[1])
    depth = plan[at].index("Join")
    below = []
    for line in plan[at + 1 :]:
        if len(line) - len(line.lstrip(" :+-")) <= depth:
            break
        below.append(line)
    assert below and not any("l_orderkey" in line for line in below)


def test_parts_add_up_to_nested_subsets(spark):
    rows = [(f"k{i // 2}" if i < 40 else f"k{i}", i % 3, i) for i in range(120)]
    df = spark.createDataFrame(rows, "row_key string, fold int, v long")
    ordered, cuts = sampling.training_subset_cuts(df, [0.1, 0.25, 1.0], seed=1)
    long = sampling.training_subset_table(ordered, cuts).groupBy("held_out", "step").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))
    parted, members = sampling.training_subset_parts(ordered, cuts)
    assert parted.count() == 120
    parts = parted.groupBy("fold", "_part").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))
    sums = parts.join(members, ["fold", "_part"]).groupBy("held_out", "step").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    assert sorted(sums.collect()) == sorted(long.collect()) and sums.count() == 9


def test_queries_on_unbalanced_rows_do_not_oversample(spark, monkeypatch):
    def oversample(*_):
        raise AssertionError("not needed here")

    monkeypatch.setattr(model_queries, "_prepared", {})
    monkeypatch.setattr(model_queries, "oversample", oversample)
    assert model_queries.logistic_coefficients(spark, "/root/testdata/sf0.001").count() > 0


def test_blocks_go_to_python_in_small_batches(spark):
    rows = spark.range(0, 180_000, 1, 1)
    features = array_to_vector(F.array(*[(F.col("id") % (i + 2)).cast("double") for i in range(16)]))
    data = pack(rows.select(features.alias("features"), (F.col("id") % 2).alias("label")), "features", "label")

    def sizes(batches):
        for pdf in batches:
            yield pdf[["n"]].assign(n=len(pdf))

    assert max(r[0] for r in data.blocks.mapInPandas(sizes, "n int").collect()) <= 4
    released(data)


def _wide_rows(spark, rows, width):
    features = array_to_vector(F.array(*[(F.col("id") % (i + 2)).cast("double") for i in range(width)]))
    return spark.range(0, rows, 1, 1).select(features.alias("features"), (F.col("id") % 2).alias("label"))


def test_blocks_of_wide_rows_are_small_and_joined_again(spark):
    data = pack(_wide_rows(spark, 50_000, 16), "features", "label")
    seen = data.written.select("n", F.octet_length("x").alias("bytes")).collect()
    assert sum(r["n"] for r in seen) == 50_000 and max(r["bytes"] for r in seen) <= 320 << 10

    def rows_at_once(batches):
        for pdf in batches:
            for block in blocks_of(iter([pdf]), 16):
                same = all(((block.x[i] % (i + 2)) == block.x[i]).all() for i in range(16)) and (block.x[0] == block.y).all()
                yield pdf[["n"]].iloc[:1].assign(n=block.n if same and len(block.key) == block.n else -1)

    got = [r[0] for r in data.blocks.mapInPandas(rows_at_once, "n int").collect()]
    assert sum(got) == 50_000 and min(got) > 0 and len(got) < len(seen)
    released(data)


def test_quantiles_are_sketched_for_few_columns_at_once(spark, monkeypatch):
    df, calls = _wide_rows(spark, 5_000, 10), []
    kind = type(df)
    whole = kind.approxQuantile

    def counted(self, columns, *rest):
        calls.append(len(columns))
        return whole(self, columns, *rest)

    monkeypatch.setattr(kind, "approxQuantile", counted)
    data = pack(df, "features", "label")
    released(data)
    assert sum(calls) == 10 and max(calls) <= 4
    assert [e.tolist() for e in data.edges] == [list(map(float, range(i + 1))) for i in range(10)]


def test_balanced_rows_are_written_once_and_small(spark, small_folder, monkeypatch):
    written, whole = [], model_queries.materialise

    def counted(df, **options):
        written.append(df.columns)
        return whole(df, **options)

    monkeypatch.setattr(model_queries, "_balanced", {})
    monkeypatch.setattr(model_queries, "materialise", counted)
    _, balanced, _ = model_queries._training_data(spark, small_folder)
    assert "fold" in balanced.columns and not any("fold" in columns for columns in written)
    files = [f.removeprefix("file://") for f in balanced.inputFiles()]
    assert {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}
    assert balanced.count() == sum(pq.ParquetFile(f).metadata.num_rows for f in files)


def test_large_steps_let_shuffle_files_go(spark, monkeypatch):
    called = []
    monkeypatch.setattr(session, "forget_shuffles", called.append)
    monkeypatch.setattr(session, "LARGE_STEP", 100_000)
    rows = spark.range(200_000)
    session.discard(session.materialise(rows.limit(10)))
    assert not called
    session.discard(session.materialise(rows))
    assert called == [spark]
