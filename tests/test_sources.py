import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from transferlens.functions.columns import banks_as_text, canonical_names, parse_time, with_calendar, with_content_key
from transferlens.sources.runlog import RunLog, check_signature, load_signature, save_signature
from transferlens.sources.tables import read_table, read_transfers_csv, write_csv, write_table

# Ten known rows of the public transfer data.
ROWS = """2022/09/02 11:26,353132,814282F31,255063,814282BC1,0.02664,Bitcoin,0.02664,Bitcoin,Bitcoin,0
2022/09/02 04:29,29003,80B58DFD0,123390,80EC2ACA0,91604.31,US Dollar,91604.31,US Dollar,ACH,0
2022/09/10 01:30,143430,810A32FA0,244192,811917200,2145.51,Shekel,2145.51,Shekel,Cheque,0
2022/09/07 21:25,16678,806484950,17554,806AAFE90,108457.21,Ruble,108457.21,Ruble,Cheque,0
2022/09/02 06:22,210,809181590,24779,80924A880,7577.02,Canadian Dollar,7577.02,Canadian Dollar,Credit Card,0
2022/09/09 19:26,33727,80C66DAE0,33727,80C66DAE0,16515.55,US Dollar,349189.96,Mexican Peso,ACH,0
2022/09/08 18:24,28694,8036FA390,122151,80BDB1470,169.14,US Dollar,169.14,US Dollar,Cash,0
2022/09/05 16:06,70,1004286A8,13057,80189B650,19878.41,Euro,19878.41,Euro,Credit Card,0
2022/09/06 15:53,9,8060A15C0,9,8060B3140,8390.38,Ruble,8390.38,Ruble,Cash,0
2022/09/09 19:12,1853,801449850,17729,808FBDE10,98.92,US Dollar,98.92,US Dollar,Cheque,0
"""
HEADER = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering\n"


@pytest.fixture
def csv_path(tmp_path):
    path = tmp_path / "transfers.csv"
    path.write_text(HEADER + ROWS)
    return str(path)


def test_csv_with_repeated_header(spark, csv_path):
    rows = with_calendar(banks_as_text(read_transfers_csv(spark, csv_path))).orderBy("timestamp").collect()
    assert len(rows) == 10
    first = rows[0]
    assert (first["account"], first["account_1"], first["from_bank"]) == ("80B58DFD0", "80EC2ACA0", "29003")
    assert (first["day"], first["time"], str(first["date"])) == ("Friday", "04:29:00", "2022-09-02")


def test_missing_path_and_bad_value_fail(spark, tmp_path):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_transfers_csv(spark, str(tmp_path / "nothing.csv"))
    bad = tmp_path / "bad.csv"
    bad.write_text(HEADER + ROWS.replace("0.02664", "much", 1))
    with pytest.raises(Exception):
        read_transfers_csv(spark, str(bad)).collect()


def test_csv_and_parquet_round_trip(spark, csv_path, tmp_path):
    df = read_transfers_csv(spark, csv_path)
    from transferlens.sources.tables import read_csv

    back = read_csv(spark, write_csv(df, str(tmp_path / "out")), df.schema)
    assert sorted(back.collect()) == sorted(df.collect())
    again = read_table(spark, write_table(df, str(tmp_path / "table"), partition_by=["payment_format"]))
    assert again.where("payment_format = 'ACH'").count() == 2


def test_names(spark):
    df = spark.createDataFrame([(1, 2)], ["From Bank", "Account.1"])
    assert canonical_names(df).columns == ["from_bank", "account_1"]
    with pytest.raises(ValueError, match="collide"):
        canonical_names(spark.createDataFrame([(1, 2)], ["A b", "a.b"]))


def test_lenient_time(spark):
    df = spark.createDataFrame([("2022/09/02 11:26",), ("no time",)], "t string")
    assert [r[0] is None for r in df.select(parse_time("t", strict=False)).collect()] == [False, True]
    with pytest.raises(Exception):
        df.select(parse_time("t")).collect()


def test_content_key_tells_null_from_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a", None)], "x string, y string")
    keys = [r["row_key"] for r in with_content_key(df).collect()]
    assert keys[0] == keys[2] != keys[1]


def test_run_log_appends(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"))
    report = spark.createDataFrame([(0.9, 0.8, 0.7)], "precision double, recall double, f1 double")
    for step in (0, 1):
        log.log_metrics(report, "r1", ["precision", "recall", "f1"], 1000 + step, step)
    log.log_run("r1", 1, 2, "FINISHED", "test")
    assert log.metrics().count() == 6
    assert log.metrics().where("metric = 'recall' and step = 1").first()["value"] == 0.8
    assert log.runs().first()["status"] == "FINISHED"


def test_signature(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    save_signature(df, df.select(F.lit(1).alias("prediction")), str(tmp_path / "signature"))
    signature = load_signature(spark, str(tmp_path / "signature"))
    check_signature(df, signature)
    with pytest.raises(ValueError, match="missing"):
        check_signature(df.drop("s"), signature)
    with pytest.raises(ValueError, match="type"):
        check_signature(df.withColumn("n", F.lit("x")), signature)


def test_transfers_follow_their_files(spark, small_folder, tmp_path):
    from transferlens.sources.transfers import transfers

    tables = ("lineitem", "orders", "customer", "supplier", "nation", "region")
    for t in tables:
        spark.read.parquet(f"{small_folder}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    folder = str(tmp_path)
    before = transfers(spark, folder)
    n = before.count()
    assert transfers(spark, folder).inputFiles() == before.inputFiles()
    spark.read.parquet(f"{small_folder}/lineitem.parquet").limit(7).write.mode("append").parquet(f"{folder}/lineitem.parquet")
    assert transfers(spark, folder).count() == n + 7
