"""Panel sources: OHLCV bars from trades, Parquet panels, hourly bars from events."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.functions.shared import shared_dir

#: The same bars as DuckDB SQL.
BARS_SQL = """
SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, arg_min(px, ord) AS open, max(px) AS high, min(px) AS low,
  arg_max(px, ord) AS close, arg_max(px, ord) AS adj_close, sum(l_quantity) AS volume
FROM (SELECT p_brand, l_shipdate, l_quantity, p_retailprice * (1 - l_discount) AS px,
        (l_orderkey, l_linenumber, l_partkey, l_suppkey) AS ord
      FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2
""".strip()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(order: dict[str, int]) -> Column:
    """One decimal(38) that sorts as the non-negative integer columns do in turn; order: column -> digits, 38 at most.

    A null counts as 0; a value with more digits than its column's is an error. A fixed-width key lets first and last
    trades be hash aggregates, where a struct of keys makes Spark sort every trade.
    """
    if sum(order.values()) > 38:
        raise ValueError("an order key has 38 digits at most")
    key, rest = [], sum(order.values())
    for c, n in order.items():
        rest -= n
        fits = f"CASE WHEN {c} >= 0 AND {c} < {10**n}BD THEN CAST({c} AS DECIMAL(38, 0)) WHEN {c} IS NULL THEN CAST(0 AS DECIMAL(38, 0)) ELSE CAST(raise_error('{c} needs more than {n} digits') AS DECIMAL(38, 0)) END"
        key.append(f"({fits}) * {10**rest}BD")
    return F.expr(" + ".join(key)).cast("decimal(38,0)")


def bars_from_trades(
    trades: DataFrame, by: str = "ticker", day: str = "date", price: str = "px", size: str = "qty", order: tuple[str, ...] | dict[str, int] = ("ord",)
) -> DataFrame:
    """One OHLCV row a ticker and day; the first and last trade by `order` open and close it.

    `order` names columns of any type, or integer columns with their digits, as for packed(). All parts are partial
    aggregates, so only one row a ticker, day and task is shuffled.
    """
    o = packed(order) if isinstance(order, dict) else F.struct(*order)
    return trades.groupBy(F.col(by).alias("ticker"), F.col(day).alias("date")).agg(
        F.min_by(price, o).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, o).alias("close"), F.max_by(price, o).alias("adj_close"), F.sum(size).alias("volume"),
    )


def derived_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel from the trades: brands as tickers, discounted retail price as the trade price."""
    items = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_quantity", "l_discount", "l_orderkey", "l_linenumber", "l_suppkey")
    parts = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    trades = items.join(parts, items.l_partkey == parts.p_partkey).select(
        F.col("p_brand").alias("ticker"), F.to_date("l_shipdate").alias("date"), F.expr("p_retailprice * (1 - l_discount)").alias("px"),
        F.col("l_quantity").alias("qty"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )
    return bars_from_trades(trades, order={"l_orderkey": 14, "l_linenumber": 2, "l_partkey": 12, "l_suppkey": 10})


#: Panels stored by this application: inputs as they were -> path.
_STORED: dict[tuple, str] = {}


def _versions(spark: SparkSession, paths: list[str]) -> tuple:
    """Names, lengths and times of change of the files at each path."""
    conf, out = spark._jsparkSession.sessionState().newHadoopConf(), []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        out += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in path.getFileSystem(conf).listStatus(path)]
    return tuple(out)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived panel, stored once by an application in the shared folder and scanned from then on.

    Trades are read again where their files have changed. Readers prune its columns and dates as in any stored panel.
    """
    key = (spark.sparkContext.applicationId, *_versions(spark, [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "part")]))
    if key not in _STORED:
        path = f"{shared_dir(spark).rstrip('/')}/bars-{uuid.uuid4().hex}"
        write_panel(derived_bars(spark, sf_dir), path)
        _STORED[key] = path
    return read_panel(spark, _STORED[key])


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """A stored panel, whichever tickers and years it is partitioned by."""
    return spark.read.parquet(path)


def write_panel(panel: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    writer = panel.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def bucket_session(spark: SparkSession) -> SparkSession:
    """A session in which tables bucketed by ticker join by ticker and date as they lie, without an exchange."""
    own = spark.newSession()
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # nothing needs to travel, small or not
    return own


def write_bucketed(panel: DataFrame, name: str, path: str, buckets: int = 64) -> None:
    """The panel as a table of the catalog at a shared path, in buckets by ticker, a file each, sorted by ticker and date.

    Families by ticker and joins by ticker and date read it without an exchange, whatever they ask of it. A ticker with most
    rows fills its bucket: such panels lie better in files by date and run in blocks (in_blocks).
    """
    dealt = panel.repartition(buckets, "ticker").sortWithinPartitions("ticker", "date")
    dealt.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, "ticker").sortBy("ticker", "date").saveAsTable(name)


#: Bucketed tables of this application: inputs as they were and buckets -> name in the catalog.
_BUCKETED: dict[tuple, str] = {}


def bucketed_bars(spark: SparkSession, sf_dir: str, buckets: int = 8) -> DataFrame:
    """The derived panel as a bucketed table, stored once an application, in a session of its own (bucket_session)."""
    key = (spark.sparkContext.applicationId, buckets, *_versions(spark, [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "part")]))
    if key not in _BUCKETED:
        name = f"bars_{uuid.uuid4().hex}"
        write_bucketed(bars(spark, sf_dir), name, f"{shared_dir(spark).rstrip('/')}/{name}", buckets)
        _BUCKETED[key] = name
    return bucket_session(spark).table(_BUCKETED[key])


def write_signals_csv(signals: DataFrame, path: str) -> None:
    signals.write.mode("overwrite").option("header", True).csv(path)


def tickers(panel: DataFrame) -> DataFrame:
    return panel.select("ticker").distinct()


def wide_assets(panel: DataFrame, names: dict[str, str], columns: list[str]) -> DataFrame:
    """(date, {asset}_{column}, ...) on the dates that all named assets (name -> ticker) share: one aggregate by date."""
    own = panel.where(F.col("ticker").isin(*names.values()))
    cell = lambda a, t, c: F.max(F.when(F.col("ticker") == t, F.col(c))).alias(f"{a}_{c}")
    here = [F.max((F.col("ticker") == t).cast("int")).alias(f"_{a}") for a, t in names.items()]
    wide = own.groupBy("date").agg(*here, *[cell(a, t, c) for a, t in names.items() for c in columns])
    return wide.where(" AND ".join(f"_{a} = 1" for a in names)).drop(*[f"_{a}" for a in names])


def read_tickers(spark: SparkSession, folder: str, wanted: list[str]) -> tuple[DataFrame, list[str]]:
    """The rows of the wanted tickers of a stored panel, and those of them that it lacks."""
    panel = spark.read.parquet(folder)
    asked = spark.createDataFrame([(t,) for t in wanted], "ticker string")
    failed = asked.join(panel.select("ticker").distinct(), "ticker", "left_anti")
    return panel.join(F.broadcast(asked), "ticker", "left_semi"), sorted(r.ticker for r in failed.collect())


def upsert(stored: DataFrame, fresh: DataFrame, keys: tuple[str, ...] = ("ticker", "date")) -> DataFrame:
    """Union of both where, for equal keys, the fresh row wins: one partial aggregate, no window."""
    columns = [c for c in stored.columns if c not in keys]
    row = F.struct(*columns)
    both = stored.select(*keys, row.alias("r"), F.lit(0).alias("b")).unionByName(fresh.select(*keys, row.alias("r"), F.lit(1).alias("b")))
    return both.groupBy(*keys).agg(F.max_by("r", "b").alias("r")).select(*keys, "r.*")
