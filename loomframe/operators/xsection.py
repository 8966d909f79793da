"""Cross-sectional operators: per date, over tickers. $panel has (ticker, date) and the named columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.functions.template import Template

DAY = "OVER (PARTITION BY date)"


def normalise(features: list[str], low: float = 0.05, high: float = 0.95, clip: float = 3.0, undivided: bool = False) -> Template:
    """Winsorise at interpolated quantiles, take off the mean, divide by the sample deviation, clip.

    Where the deviation is zero or unknown the value becomes 0 (`undivided`: the demeaned value stays). Quantiles
    are one aggregate a date, joined back; mean and deviation are one window over the same partitioning.
    """
    q = ", ".join(f"PCTL({f}, {low}) AS {f}_lo, PCTL({f}, {high}) AS {f}_hi" for f in features)
    w = ", ".join(f"CASE WHEN p.{f} IS NOT NULL THEN least(greatest(p.{f}, {f}_lo), {f}_hi) END AS {f}" for f in features)
    m = ", ".join(f"avg({f}) {DAY} AS {f}_m, stddev_samp({f}) {DAY} AS {f}_s, max({f}) {DAY} > min({f}) {DAY} AS {f}_v" for f in features)

    def z(f: str) -> str:
        flat = f"{f} - {f}_m" if undivided else "0.0"
        scaled = f"CASE WHEN {f}_v THEN ({f} - {f}_m) / {f}_s ELSE {flat} END"
        return f"CASE WHEN {f} IS NOT NULL THEN round(least({clip}, greatest(-{clip}, {scaled})), 5) + 0.0 END AS {f}"

    return Template(f"""
WITH q AS (SELECT date, {q} FROM $panel GROUP BY date),
w AS (SELECT p.ticker, p.date, {w} FROM $panel p JOIN q ON p.date = q.date),
m AS (SELECT ticker, date, {', '.join(features)}, {m} FROM w)
SELECT ticker, date, {', '.join(z(f) for f in features)} FROM m""")


def percent_rank(x: str, by: str = "") -> str:
    """Average rank over the day's count of non-null values; `by` ("split_id, ") tells runs apart."""
    w = f"(PARTITION BY {by}date, {x} IS NULL ORDER BY {x})"
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER {w} + (count(*) OVER (PARTITION BY {by}date, {x}) - 1) / 2e0) / count({x}) OVER (PARTITION BY {by}date) END"


def ranks(x: str = "signal") -> Template:
    return Template(f"SELECT ticker, date, round({percent_rank(x)}, 8) AS pct_rank FROM $panel")


def deciles(x: str = "signal", cut: float = 0.1, least: int = 10) -> Template:
    """1 at or above the top cut, -1 at or below the bottom one, on days with enough names."""
    return Template(f"""
WITH r AS (SELECT ticker, date, round({percent_rank(x)}, 9) AS r, count({x}) {DAY} AS n FROM $panel)
SELECT ticker, date, CASE WHEN r IS NULL OR n < {least} THEN NULL WHEN r >= {1 - cut} THEN 1 WHEN r <= {cut} THEN -1 ELSE 0 END AS side FROM r""")


def quantile_buckets(x: str = "signal", n: int = 10, extra: str = "") -> str:
    """Buckets by linear quantile edges, right-closed, repeated edges merged; null on days with fewer than n names."""
    edges = ", ".join(f"PCTL({x}, {i / n}) AS e{i}" for i in range(n))
    count = " + ".join(f"CASE WHEN e{i} > e{i - 1} AND e{i} < {x} THEN 1 ELSE 0 END" for i in range(1, n))
    more = f", {extra}" if extra else ""
    return f"""
SELECT ticker, p.date AS date{more}, CASE WHEN {x} IS NULL OR n < {n} THEN NULL ELSE {count} END AS bucket
FROM $panel p JOIN (SELECT date AS d, count({x}) AS n, {edges} FROM $panel GROUP BY date) e ON p.date = e.d"""


def date_slice(day: str, features: list[str]) -> Template:
    return Template(f"SELECT ticker, {', '.join(f'coalesce({f}, 0) AS {f}' for f in features)} FROM $panel WHERE date = DATE '{day}'")


def cube(start: str, end: str, features: list[str]) -> Template:
    """Dense dates x tickers grid of features, null where a cell is missing: the rows of a (dates, tickers, features) cube,
    whose size is the result's own."""
    span = f"(SELECT * FROM $panel WHERE date BETWEEN DATE '{start}' AND DATE '{end}')"
    return Template(f"""
WITH d AS (SELECT DISTINCT date FROM {span} a), t AS (SELECT DISTINCT ticker FROM {span} b), g AS (SELECT date, ticker FROM d CROSS JOIN t)
SELECT g.date, g.ticker, {', '.join(f'p.{f}' for f in features)} FROM g LEFT JOIN {span} p ON g.date = p.date AND g.ticker = p.ticker""")


def last_sequences(panel: DataFrame, day: str, length: int, features: list[str]) -> DataFrame:
    """(ticker, seq): the features of the last `length` dates of the panel up to a day, as array<array<double>>.

    Dates are those of all tickers within twice as many calendar days; with fewer than `length` of them there are no rows.
    Every ticker of that span has a sequence; a missing row or value is 0.
    """
    near = panel.where((F.col("date") <= F.lit(day).cast("date")) & (F.datediff(F.lit(day).cast("date"), "date") <= 2 * length))
    dates = near.select("date").distinct().orderBy(F.col("date").desc()).limit(length)
    steps = dates.withColumns({"step": F.row_number().over(Window.orderBy("date")), "n": F.count(F.lit(1)).over(Window.partitionBy())})
    steps = steps.where(F.col("n") == length).select("date", "step")
    grid = near.select("ticker").distinct().crossJoin(F.broadcast(steps))  # the result's own size; `length` dates
    values = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    rows = grid.join(near.select("ticker", "date", *features), ["ticker", "date"], "left")
    return rows.groupBy("ticker").agg(F.transform(F.sort_array(F.collect_list(F.struct("step", values.alias("v")))), lambda r: r["v"]).alias("seq"))


def supervised(panel: DataFrame, length: int, features: list[str], target: str) -> DataFrame:
    """(ticker, date, seq, y): the features of the `length` rows before a row as array<array<double>>, and the row's target.

    One window over the panel's partitioning; a task holds `length` rows of lists at a time.
    """
    before = Window.partitionBy("ticker").orderBy("date").rowsBetween(-length, -1)
    seq = F.collect_list(F.array(*[F.col(f).cast("double") for f in features])).over(before)
    return panel.select("ticker", "date", seq.alias("seq"), F.col(target).alias("y")).where(F.size("seq") == length)


def steps_of(sequences: DataFrame, features: list[str], digits: int = 7) -> DataFrame:
    """The rows of sequences: `seq` as step (from 0) and a column a feature, for engines without nested arrays."""
    keys = [c for c in sequences.columns if c != "seq"]
    rows = sequences.select(*keys, F.posexplode("seq").alias("step", "v"))
    return rows.select(*keys, "step", *[F.round(F.col("v")[i], digits).alias(f) for i, f in enumerate(features)])


def sector_exposure() -> Template:
    """Net weight of every sector on every date with weights, 0 for a sector without any."""
    return Template("""
WITH e AS (SELECT date, sector, sum(weight) AS w FROM $weights WHERE weight IS NOT NULL GROUP BY date, sector),
g AS (SELECT date, sector FROM (SELECT DISTINCT date FROM $weights) d CROSS JOIN (SELECT DISTINCT sector FROM $weights) s)
SELECT g.date, g.sector, round(coalesce(w, 0), 8) + 0.0 AS exposure FROM g LEFT JOIN e ON g.date = e.date AND g.sector = e.sector""")


def factor_exposure(factors: list[str]) -> Template:
    return Template(f"SELECT w.date AS date, {', '.join(f'round(sum(w.weight * p.{f}), 9) + 0.0 AS {f}' for f in factors)} FROM $weights w JOIN $panel p ON w.ticker = p.ticker AND w.date = p.date GROUP BY w.date")


def concentration() -> Template:
    return Template("SELECT date, round(sum(weight * weight), 8) AS hhi FROM $weights GROUP BY date")
