"""Bars from a provider's responses, one request a ticker and uncovered stretch of dates, over a cache that knows its coverage.

The provider is a folder: `ticker=<name>/` holds a ticker's answer as lines of JSON (date, open, high, low, close, volume). Any
file system of pyarrow.fs will do. A session reads it through Spark's Python data source, a task a request.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Iterator
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from loomframe.functions.shared import stored
from loomframe.functions.template import Template

_PRICES = ("open", "high", "low", "close", "volume")
_SCHEMA = "ticker string, date date, " + ", ".join(f"{c} double" for c in _PRICES) + ", lo date, hi date, error string"
_DAY = datetime.timedelta(days=1)


class Request(InputPartition):
    """One question to the provider: a ticker from one day to another, both included."""

    def __init__(self, ticker: str, lo: datetime.date, hi: datetime.date) -> None:
        self.ticker, self.lo, self.hi = ticker, lo, hi


class ResponseReader(DataSourceReader):
    """Plans a task a request; filters on ticker and date make fewer and shorter requests."""

    def __init__(self, options) -> None:
        self.folder = options["path"]
        days = datetime.date.fromisoformat
        self.requests = [Request(t, days(lo), days(hi)) for t, lo, hi in json.loads(options["requests"])]

    def pushFilters(self, filters):
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("ticker",) and isinstance(f, (EqualTo, In)):
                wanted = {value} if isinstance(f, EqualTo) else set(value)
                self.requests = [r for r in self.requests if r.ticker in wanted]
            elif column == ("date",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                low = {EqualTo: value, GreaterThanOrEqual: value, GreaterThan: value + _DAY}.get(type(f), datetime.date.min)
                high = {EqualTo: value, LessThanOrEqual: value, LessThan: value - _DAY}.get(type(f), datetime.date.max)
                cut = [Request(r.ticker, max(r.lo, low), min(r.hi, high)) for r in self.requests]
                self.requests = [r for r in cut if r.lo <= r.hi]
                yield f  # a failed request's row has no date, so Spark still tests it
            else:
                yield f

    def partitions(self):
        return self.requests or [Request("", datetime.date.max, datetime.date.min)]

    def read(self, request: Request) -> Iterator[tuple]:
        """The bars of a request, or one row that says what went wrong with it."""
        if not request.ticker:
            return
        rows = []
        try:
            system, root = fs.FileSystem.from_uri(self.folder)
            for file in system.get_file_info(fs.FileSelector(f"{root}/ticker={quote(request.ticker, safe='')}")):
                if file.base_name.startswith(("_", ".")):
                    continue
                for line in system.open_input_stream(file.path).read().splitlines():
                    bar = json.loads(line)
                    day = datetime.date.fromisoformat(bar["date"])
                    if request.lo <= day <= request.hi:
                        rows.append((request.ticker, day, *[None if bar.get(c) is None else float(bar[c]) for c in _PRICES], request.lo, request.hi, None))
        except (OSError, ValueError, KeyError, TypeError) as e:
            rows = [(request.ticker, None, *[None] * len(_PRICES), request.lo, request.hi, f"{type(e).__name__}: {e}"[:200])]
        yield from rows


class ResponseSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loom_responses"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> ResponseReader:
        return ResponseReader(self.options)


def ask(spark: SparkSession, folder: str, requests: list[tuple[str, datetime.date, datetime.date]]) -> DataFrame:
    """(ticker, date, prices, lo, hi, error) of the provider's answers: a task a request, a row with an error for a failed one."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ResponseSource)
    asked = json.dumps([(t, lo.isoformat(), hi.isoformat()) for t, lo, hi in requests])
    return spark.read.format("loom_responses").option("requests", asked).load(folder)


def gaps() -> Template:
    """(ticker, lo, hi) of the days of $wanted (ticker, lo, hi) that $covered (ticker, lo, hi) lacks, as longest stretches.

    Covered stretches may overlap, touch and repeat: each is set against the furthest day that those before it reach.
    """
    far = "max(hi) OVER (PARTITION BY ticker, wlo, whi ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return Template(f"""
WITH w AS (SELECT DISTINCT ticker, lo AS wlo, hi AS whi FROM $wanted WHERE lo <= hi),
met AS (SELECT w.*, c.lo, c.hi FROM w JOIN $covered c ON w.ticker = c.ticker AND c.hi >= wlo AND c.lo <= whi
  UNION ALL SELECT *, ADDDAYS(whi, 1) AS lo, ADDDAYS(whi, 1) AS hi FROM w),
r AS (SELECT *, ADDDAYS(greatest(coalesce({far}, ADDDAYS(wlo, -1)), ADDDAYS(wlo, -1)), 1) AS begins FROM met)
SELECT ticker, begins AS lo, ADDDAYS(lo, -1) AS hi FROM r WHERE begins < lo""")


class Cache:
    """A folder of bars by fetch, and of what the fetches covered. A fetch counts once its coverage is written, which comes last:
    bars of one that was cut short are never read."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path)

    def covered(self) -> DataFrame:
        """(ticker, lo, hi, fetch): stretches of days that a fetch has answered, with or without bars."""
        ddl = "ticker string, lo date, hi date, fetch string"
        return self.spark.read.schema(ddl).parquet(f"{self.folder}/coverage") if self._there("coverage") else self.spark.createDataFrame([], ddl)

    def bars(self) -> DataFrame:
        """(ticker, date, prices) of the fetches that were finished."""
        ddl = "ticker string, date date, " + ", ".join(f"{c} double" for c in _PRICES) + ", fetch string"
        rows = self.spark.read.schema(ddl).parquet(f"{self.folder}/bars") if self._there("bars") else self.spark.createDataFrame([], ddl)
        return rows.join(self.covered().select("fetch").distinct(), "fetch", "left_semi").drop("fetch")

    def fetch(self, provider: str, wanted: DataFrame, refresh: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Asks for the days of wanted (ticker, lo, hi) that are not covered, and keeps the answers.

        Returns the bars of wanted, the failed requests (ticker, lo, hi, error), and all requests (ticker, lo, hi) that were made. A
        failed request covers nothing, so the next fetch asks again; an answer without bars covers its days. Requests are planned
        on the driver: a row a ticker and gap. `refresh` asks for all days and lets the new bars win.
        """
        wanted = wanted.select("ticker", "lo", "hi")
        covered = self.covered().select("ticker", "lo", "hi")
        missing = wanted if refresh else gaps().apply(self.spark, wanted=wanted, covered=covered)
        asked = sorted({(r.ticker, r.lo, r.hi) for r in missing.collect()})
        requests = self.spark.createDataFrame(asked, "ticker string, lo date, hi date")
        answers = stored(ask(self.spark, provider, asked), "answers")
        failed = answers.where("error IS NOT NULL").select("ticker", "lo", "hi", "error")
        fetch = F.lit(f"{datetime.datetime.now(datetime.UTC):%Y%m%d%H%M%S%f}-{uuid.uuid4().hex}")
        good = answers.where("error IS NULL").select("ticker", "date", *_PRICES, fetch.alias("fetch"))
        good.write.mode("append").parquet(f"{self.folder}/bars")
        done = requests.join(failed, ["ticker", "lo", "hi"], "left_anti").select("*", fetch.alias("fetch"))
        done.write.mode("append").parquet(f"{self.folder}/coverage")
        return self.latest(wanted), failed, requests

    def latest(self, wanted: DataFrame) -> DataFrame:
        """One bar a ticker and day of wanted; that of the latest fetch where several have it."""
        ddl = "ticker string, date date, " + ", ".join(f"{c} double" for c in _PRICES) + ", fetch string"
        rows = self.spark.read.schema(ddl).parquet(f"{self.folder}/bars").join(self.covered().select("fetch").distinct(), "fetch", "left_semi")
        bar = F.max_by(F.struct(*_PRICES), "fetch").alias("bar")
        own = rows.join(wanted.distinct(), "ticker").where("date BETWEEN lo AND hi").groupBy("ticker", "date").agg(bar)
        return own.select("ticker", "date", "bar.*")
