"""Values of stored panels, of their subsets and of signal files."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomframe.sources import bars as src

SF = "/root/testdata/sf0.001"


def rows(df, columns=("ticker", "date", "open", "high", "low", "close", "volume")):
    return df.select(*columns).toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)


@pytest.mark.parametrize("parts", [(), ("ticker",), ("year",)])
def test_stored_panels_hold_the_bars(spark, tmp_path, parts):
    """Whatever a panel is partitioned by, its values come back, nulls among them, and filters prune its files."""
    panel = src.derived_bars(spark, SF).withColumn("volume", F.expr("CASE WHEN day(date) % 9 > 0 THEN volume END")).withColumn("year", F.year("date"))
    want = rows(panel)
    src.write_panel(panel, str(tmp_path / "p"), parts)
    pd.testing.assert_frame_equal(rows(src.read_panel(spark, str(tmp_path / "p"))), want, check_exact=True)
    one = src.read_panel(spark, str(tmp_path / "p")).where("ticker = 'Brand#11' AND year = 1996")
    own = want[(want.ticker == "Brand#11") & (pd.to_datetime(want.date).dt.year == 1996)].reset_index(drop=True)
    pd.testing.assert_frame_equal(rows(one), own, check_exact=True)
    if parts:
        assert "PartitionFilters: [isnotnull(" + parts[0] in one._jdf.queryExecution().executedPlan().toString()
    src.write_panel(panel.where("ticker = 'Brand#12'"), str(tmp_path / "p"), parts)  # written anew, not added to
    assert src.tickers(src.read_panel(spark, str(tmp_path / "p"))).collect() == [("Brand#12",)]


def test_wanted_tickers_come_with_their_values(spark, tmp_path):
    panel = src.derived_bars(spark, SF)
    src.write_panel(panel, str(tmp_path / "p"))
    got, failed = src.read_tickers(spark, str(tmp_path / "p"), ["Brand#11", "none", "Brand#2"])
    want = rows(panel)
    pd.testing.assert_frame_equal(rows(got), want[want.ticker.isin(["Brand#11", "Brand#2"])].reset_index(drop=True), check_exact=True)
    assert failed == ["none"]


def test_signal_files(spark, tmp_path):
    """Dates, signs, quotes and missing values of a signal file; a second writing replaces the first."""
    data = [("A,B", dt.date(2024, 1, 2), 1, 0.125), ('Q"x', dt.date(2024, 1, 2), -1, None), ("é", dt.date(2024, 1, 3), 0, -1e-9)]
    ddl = "ticker string, date date, position int, weight double"
    df = spark.createDataFrame(data, ddl)
    for _ in range(2):
        src.write_signals_csv(df, str(tmp_path / "s"))
        back = spark.read.schema(ddl).option("header", True).csv(str(tmp_path / "s"))
        assert sorted(map(tuple, back.collect())) == sorted(data)
    heads = {next(iter(p.open())).strip() for p in (tmp_path / "s").glob("part-*.csv")}
    assert heads == {"ticker,date,position,weight"}


def test_upserts_by_value(spark):
    """The fresh row wins with all its columns, missing values included; other rows stay as they are."""
    ddl = "ticker string, date date, close double, volume double"
    d = [dt.date(2024, 1, k) for k in (1, 2, 3)]
    old = spark.createDataFrame([("A", d[0], 1.0, 10.0), ("A", d[1], 2.0, 20.0), ("B", d[0], 3.0, None)], ddl)
    new = spark.createDataFrame([("A", d[1], None, 21.0), ("A", d[2], 4.0, 40.0)], ddl)
    assert sorted(map(tuple, src.upsert(old, new).collect())) == [("A", d[0], 1.0, 10.0), ("A", d[1], None, 21.0), ("A", d[2], 4.0, 40.0), ("B", d[0], 3.0, None)]
