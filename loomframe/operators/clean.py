"""Cleaning and reshaping of OHLCV panels, as declarative templates over $panel (ticker, date, open ... volume)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.functions.sqlsteps import lag, lead
from loomframe.functions.template import Template

PRICES = ("open", "high", "low", "close")
FIVE = (*PRICES, "volume")
SO_FAR = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
AHEAD = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
PER = "OVER (PARTITION BY ticker)"

FIXED = "greatest(high, open, close) AS high, least(low, open, close) AS low"


def fix_ohlc() -> Template:
    """High and low hold open and close, skipping nulls."""
    return Template(f"SELECT ticker, date, open, {FIXED}, close, volume FROM $panel WHERE seq = 0")


def _outlier_chain(src: str, most: float) -> str:
    nulled = ", ".join(f"CASE WHEN abs(cf / pf - 1) > {most} THEN NULL ELSE {c} END AS {c}" for c in PRICES)
    return f"""cf AS (SELECT *, LASTNN(close) {SO_FAR} AS cf FROM {src}),
pf AS (SELECT *, {lag('cf')} AS pf FROM cf),
quiet AS (SELECT ticker, date, {nulled}, volume, n0 FROM pf)"""


def price_outliers(most: float = 0.5) -> Template:
    """Moves beyond `most` lose their prices (not their volume); gaps are bridged for the move."""
    return Template(f"WITH src AS (SELECT *, 0 AS n0 FROM $panel WHERE seq = 0), {_outlier_chain('src', most)} SELECT ticker, date, {', '.join(FIVE)} FROM quiet")


def clean_ohlcv(max_missing: float = 0.1, most: float = 0.5) -> Template:
    """Deduplicate (last wins), drop negatives, fix ranges, drop outliers, reject gappy tickers, fill forward, reject
    tickers with impossible prices or under half of their rows."""
    pos = ", ".join(f"CASE WHEN {c} < 0 THEN NULL ELSE {c} END AS {c}" for c in FIVE)
    gaps = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in FIVE)
    fill = ", ".join(f"LASTNN({c}) {SO_FAR} AS {c}" for c in FIVE)
    bad = " OR ".join(f"{c} IS NULL OR {c} = 0" for c in PRICES)
    return Template(f"""
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY seq DESC) AS rn, count(*) {PER} AS n0 FROM $panel),
pos AS (SELECT ticker, date, {pos}, n0 FROM ranked WHERE rn = 1),
fixed AS (SELECT ticker, date, open, {FIXED}, close, volume, n0 FROM pos),
{_outlier_chain('fixed', most)},
gaps AS (SELECT *, avg(CAST({gaps} AS DOUBLE) / 5) {PER} AS missing FROM quiet),
filled AS (SELECT ticker, date, {fill}, missing, n0 FROM gaps),
rows_ AS (SELECT ticker, date, {', '.join(PRICES)}, coalesce(volume, 0) AS volume, n0 FROM filled WHERE close IS NOT NULL AND missing <= {max_missing}),
checked AS (SELECT *, min(close) {PER} AS lo, max(close) {PER} AS hi, count(*) {PER} AS n1,
  sum(CASE WHEN {bad} THEN 1 ELSE 0 END) {PER} AS bad FROM rows_)
SELECT ticker, date, {', '.join(FIVE)} FROM checked WHERE lo >= 0.01 AND hi <= 1000000 AND n1 >= 0.5 * n0 AND bad = 0""")


def validate() -> Template:
    """Per ticker: rows, null or zero prices, range of the close, and whether it is fit for use."""
    bad = " OR ".join(f"{c} IS NULL OR {c} = 0" for c in PRICES)
    return Template(f"""
SELECT ticker, count(*) AS n_rows, sum(CASE WHEN {bad} THEN 1 ELSE 0 END) AS n_bad, round(min(close), 6) AS lo, round(max(close), 6) AS hi,
  sum(CASE WHEN {bad} THEN 1 ELSE 0 END) = 0 AND min(close) >= 0.01 AND max(close) <= 1000000 AS valid FROM $panel GROUP BY ticker""")


def forward_fill() -> Template:
    return Template(f"SELECT ticker, date, {', '.join(f'LASTNN({c}) {SO_FAR} AS {c}' for c in FIVE)} FROM $panel WHERE seq = 0")


def interpolate(columns: tuple[str, ...] = FIVE) -> Template:
    """Linear in elapsed days between known values; the last value holds on, nothing is put before the first."""
    ends, out = [], []
    for c in columns:
        known = f"CASE WHEN {c} IS NOT NULL THEN date END"
        ends.append(f"{c}, LASTNN({c}) {SO_FAR} AS {c}_x0, LASTNN({known}) {SO_FAR} AS {c}_t0, FIRSTNN({c}) {AHEAD} AS {c}_x1, FIRSTNN({known}) {AHEAD} AS {c}_t1")
        out.append(f"""round(CASE WHEN {c} IS NOT NULL THEN {c} WHEN {c}_x1 IS NULL THEN {c}_x0
  ELSE {c}_x0 + ({c}_x1 - {c}_x0) * DAYS(date, {c}_t0) / DAYS({c}_t1, {c}_t0) END, 6) AS {c}""")
    return Template(f"WITH ends AS (SELECT ticker, date, {', '.join(ends)} FROM $panel WHERE seq = 0) SELECT ticker, date, {', '.join(out)} FROM ends")


CALENDAR = "SELECT d AS date FROM (SELECT DAYSEQ({a}, {b}) AS d FROM {src}) days WHERE WEEKDAY(d) < 5"


def align_to_calendar() -> Template:
    """Every ticker on every business day of the panel's span, filled forward. The calendar and the list of tickers
    are small dimensions: one row a day and one a ticker."""
    cal = CALENDAR.format(a="lo", b="hi", src="(SELECT min(date) AS lo, max(date) AS hi FROM $panel) span")
    fill = ", ".join(f"LASTNN(p.{c}) OVER (PARTITION BY g.ticker ORDER BY g.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" for c in FIVE)
    return Template(f"""
WITH cal AS ({cal}), names AS (SELECT DISTINCT ticker FROM $panel), grid AS (SELECT ticker, date FROM names CROSS JOIN cal)
SELECT g.ticker, g.date, {fill} FROM grid g LEFT JOIN $panel p ON g.ticker = p.ticker AND g.date = p.date""")


def returns() -> Template:
    return Template(f"SELECT ticker, date, round(adj_close / {lag('adj_close')} - 1, 8) + 0.0 AS ret, round(ln(adj_close / {lag('adj_close')}), 8) + 0.0 AS log_ret FROM $panel")


def forward_returns(horizons=(1, 5, 10, 21)) -> Template:
    cols = ", ".join(f"round({lead('adj_close', h)} / adj_close - 1, 8) + 0.0 AS fwd_{h}d" for h in horizons)
    return Template(f"SELECT ticker, date, {cols} FROM $panel")


def build_panel(start: str, end: str) -> Template:
    return Template(f"SELECT ticker, date, open, high, low, close, volume FROM $panel WHERE date BETWEEN DATE '{start}' AND DATE '{end}'")


def pivot_wide(panel: DataFrame, column: str = "close", tickers: list[str] | None = None) -> DataFrame:
    """A row a date and a column a ticker. Given tickers spare the job that finds them."""
    grouped = panel.groupBy("date")
    return (grouped.pivot("ticker", tickers) if tickers else grouped.pivot("ticker")).agg(F.first(column))


def unpivot_long(wide: DataFrame, column: str = "value") -> DataFrame:
    return wide.unpivot("date", [c for c in wide.columns if c != "date"], "ticker", column).where(F.col(column).isNotNull())


def select_columns(panel: DataFrame, prefix: str) -> DataFrame:
    """Lower-case names with underscores, with a prefix but for the keys."""
    return panel.select(*[F.col(c).alias(c if c in ("ticker", "date") else f"{prefix}_{c.lower().replace(' ', '_')}") for c in panel.columns])


def market_check(min_close: float = 5, min_dollars: float = 1e6, max_missing: float = 0.1) -> Template:
    """Per ticker: last close, mean dollar volume of the last 21 rows, share of missing values, and the verdict."""
    gaps = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in FIVE)
    return Template(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM $panel WHERE seq = 0),
g AS (SELECT ticker, ARGMAX(close, date) AS last_close, avg(CASE WHEN k <= 21 THEN close * volume END) AS dollars,
  avg(CAST({gaps} AS DOUBLE) / 5) AS missing FROM r GROUP BY ticker)
SELECT ticker, round(last_close, 6) AS last_close, round(dollars, 4) AS dollars, round(missing, 8) AS missing,
  coalesce(last_close >= {min_close} AND dollars >= {min_dollars} AND missing <= {max_missing}, FALSE) AS passed FROM g""")


def drop_incomplete() -> Template:
    return Template(f"SELECT ticker, date, {', '.join(FIVE)} FROM $panel WHERE seq = 0 AND {' AND '.join(f'{c} IS NOT NULL' for c in FIVE)}")


def fill_zero() -> Template:
    return Template(f"SELECT ticker, date, {', '.join(f'coalesce({c}, 0) AS {c}' for c in FIVE)} FROM $panel WHERE seq = 0")
