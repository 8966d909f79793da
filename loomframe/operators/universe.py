"""Point-in-time universes: change logs, calendars, as-of joins."""

from __future__ import annotations

from loomframe.functions.sqlsteps import last
from loomframe.functions.template import Template

from .clean import CALENDAR


def reconstruct(start: str, end: str) -> Template:
    """Membership a business day from $changes (ticker, date, action) and $current (ticker).

    An add opens (its day, the next change]; a ticker whose first change is a removal was in up to that day; a
    current member without changes always was. Validity intervals meet the calendar in one range join; the
    intervals are a row a change, which is the small side.
    """
    cal = CALENDAR.format(a=f"DATE '{start}'", b=f"DATE '{end}'", src="(SELECT 1 AS one) o")
    return Template(f"""
WITH cal AS ({cal}),
ev AS (SELECT ticker, date, action, lead(date) OVER (PARTITION BY ticker ORDER BY date, action) AS nxt,
  row_number() OVER (PARTITION BY ticker ORDER BY date, action) AS k FROM $changes),
spans AS (
  SELECT ticker, date AS lo, coalesce(nxt, DATE '9999-01-01') AS hi FROM ev WHERE action = 'add'
  UNION ALL SELECT ticker, DATE '0001-01-01', date FROM ev WHERE action = 'remove' AND k = 1
  UNION ALL SELECT ticker, DATE '0001-01-01', DATE '9999-01-01' FROM $current c WHERE NOT EXISTS (SELECT 1 FROM $changes x WHERE x.ticker = c.ticker))
SELECT DISTINCT cal.date AS date, ticker, TRUE AS in_universe FROM cal JOIN spans ON cal.date > lo AND cal.date <= hi""")


def business_days(start: str, end: str) -> Template:
    return Template(CALENDAR.format(a=f"DATE '{start}'", b=f"DATE '{end}'", src="(SELECT 1 AS one) o"))


def business_days_of() -> Template:
    """The business days from the first to the last date of $panel."""
    return Template(CALENDAR.format(a="lo", b="hi", src="(SELECT min(date) AS lo, max(date) AS hi FROM $panel) span"))


def full_universe(start: str, end: str) -> Template:
    """$members (date, ticker, in_universe) and, on each business day, the $extra tickers; a pair once."""
    cal = CALENDAR.format(a=f"DATE '{start}'", b=f"DATE '{end}'", src="(SELECT 1 AS one) o")
    return Template(f"""
WITH cal AS ({cal}) SELECT date, ticker, max(in_universe) AS in_universe FROM (
  SELECT date, ticker, in_universe FROM $members UNION ALL SELECT cal.date, x.ticker, TRUE FROM cal CROSS JOIN $extra x) u
GROUP BY date, ticker""")


def on_date(day: str) -> Template:
    return Template(f"SELECT ticker FROM $members WHERE date = DATE '{day}' AND in_universe")


def date_range(start: str, end: str) -> Template:
    return Template(f"SELECT date, ticker FROM $members WHERE date BETWEEN DATE '{start}' AND DATE '{end}' AND in_universe")


def liquidity_filter(min_price: float = 5, min_dollars: float = 1e6, rows: int = 21, least: int = 5) -> Template:
    """Members whose last `rows` bars up to the day (at least `least`) have enough mean price and dollar volume.

    The trailing means are windows over bars; members then take the last bar at or before their day: both sides
    go through one window per ticker (a union and the last value seen), so no range join is needed.
    """
    w = last(rows)
    both = "OVER (PARTITION BY ticker ORDER BY date, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return Template(f"""
WITH b AS (SELECT ticker, date, avg(close) {w} AS price, avg(close * volume) {w} AS dollars, count(*) {w} AS n FROM $panel),
u AS (SELECT ticker, date, 0 AS side, price, dollars, n FROM b
  UNION ALL SELECT ticker, date, 1, NULL, NULL, NULL FROM $members WHERE in_universe),
s AS (SELECT ticker, date, side, LASTNN(price) {both} AS price, LASTNN(dollars) {both} AS dollars, LASTNN(n) {both} AS n FROM u)
SELECT ticker, date, round(price, 5) AS price, round(dollars, 3) AS dollars FROM s
WHERE side = 1 AND n >= {least} AND price >= {min_price} AND dollars >= {min_dollars}""")


def latest() -> Template:
    return Template("SELECT ticker, date FROM $members WHERE date = (SELECT max(date) FROM $members) AND in_universe")


def nearest_date(day: str) -> Template:
    return Template(f"SELECT ticker, date, round(close, 6) AS close FROM $panel WHERE date = (SELECT max(date) FROM $panel WHERE date <= DATE '{day}')")


def adv_snapshot(rows: int = 21, least: int = 5) -> Template:
    return Template(f"""
SELECT ticker, round(avg(close * volume), 4) AS adv FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM $panel) r
WHERE k <= {rows} GROUP BY ticker HAVING count(*) >= {least}""")


def period_tickers(start: str, end: str) -> Template:
    return Template(f"SELECT DISTINCT ticker FROM $members WHERE date BETWEEN DATE '{start}' AND DATE '{end}' AND in_universe")
