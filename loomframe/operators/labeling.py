"""Triple-barrier events, uniqueness weights and meta labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.functions.sqlsteps import lag, last, rolling
from loomframe.functions.template import Template

ORD = "OVER (PARTITION BY ticker ORDER BY date)"
TOTAL = "OVER (PARTITION BY ticker)"


def daily_vol(k: int = 20) -> Template:
    return Template(f"""WITH r AS (SELECT ticker, date, close / {lag('close')} - 1 AS ret FROM $panel)
SELECT ticker, date, round({rolling('stddev_samp', 'ret', k)}, 7) AS vol FROM r""")


def ewm_vol(panel: DataFrame, span: int = 20) -> DataFrame:
    """(ticker, date, vol): deviation of simple returns with exponential weights (1 - a)^age, a = 2 / (span + 1), corrected
    for bias; a recurrence over a ticker's rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        return pd.DataFrame({"ticker": pdf.ticker, "date": pdf.date, "vol": pdf.close.pct_change().ewm(span=span).std()})

    out = panel.select("ticker", "date", F.col("close").cast("double")).groupBy("ticker").applyInPandas(run, "ticker string, date date, vol double")
    return out.select("ticker", "date", F.nanvl("vol", F.lit(None)).alias("vol"))


def _touch(h: int, width: float, k: int) -> str:
    """CTEs up to `hit`: each row with its volatility, returns of the next h closes and the first touched step.

    The next h closes are lead() columns of one window, so first touch is a row expression: no self-join, no list.
    """
    leads = ", ".join(f"lead(close, {j}) {ORD} AS c{j}, lead(date, {j}) {ORD} AS d{j}" for j in range(1, h + 1))
    rets = ", ".join(f"round(c{j} / close - 1, 9) AS r{j}" for j in range(1, h + 1))
    touched = " ".join(f"WHEN r{j} >= b OR r{j} <= -b THEN {j}" for j in range(1, h + 1))
    ahead = " + ".join(f"CASE WHEN c{j} IS NULL THEN 0 ELSE 1 END" for j in range(1, h + 1))
    names = ", ".join(f"c{j}, d{j}" for j in range(1, h + 1))
    return f"""
r AS (SELECT ticker, date, close, close / {lag('close')} - 1 AS ret, row_number() {ORD} - 1 AS i, count(*) {TOTAL} AS n, {leads} FROM $panel),
v AS (SELECT *, {rolling('stddev_samp', 'ret', k)} AS vol FROM r),
s AS (SELECT ticker, date, close, i, n, vol, round({width} * vol, 9) AS b, {names}, {rets} FROM v WHERE vol > 0),
hit AS (SELECT *, CASE {touched} END AS j, {ahead} AS ahead FROM s)"""


def barrier_events(h: int = 10, width: float = 1.5, k: int = 20, least: float = 0.005, batch: bool = False) -> Template:
    """First touch of +-width * vol within h rows, the upper side first; else a time exit, labelled by its sign where
    its size reaches `least`. `batch` leaves out the last rows, which lack a full horizon, and the barrier columns."""
    at = lambda c, default: "CASE held " + " ".join(f"WHEN {j} THEN {c}{j}" for j in range(1, h + 1)) + f" ELSE {default} END"
    barriers = "" if batch else ", round(close * (1 + b), 5) AS upper_barrier, round(close * (1 - b), 5) AS lower_barrier"
    where = f"i < n - {h} - 1" if batch else f"i >= {k}"
    return Template(f"""
WITH {_touch(h, width, k)},
e AS (SELECT *, coalesce(j, ahead) AS held FROM hit WHERE {where}),
t AS (SELECT *, {at('d', 'date')} AS first_touch_date, coalesce({', '.join(f'd{j}' for j in range(h, 0, -1))}, date) AS t1, {at('r', '0.0')} AS ret_ FROM e)
SELECT ticker, date AS t0, t1, first_touch_date, CASE WHEN j IS NULL THEN 0 WHEN ret_ >= b THEN 1 ELSE -1 END AS barrier_side,
  ret_ + 0.0 AS return_at_touch, CAST(held AS INT) AS days_held,
  CASE WHEN j IS NOT NULL THEN CASE WHEN ret_ >= b THEN 1 ELSE -1 END WHEN abs(ret_) >= {least} THEN CAST(sign(ret_) AS INT) ELSE 0 END AS label{barriers}
FROM t""")


def uniqueness_weights() -> Template:
    """1 / mean concurrency over an event's life, scaled to sum 1 a ticker. $events has (ticker, t0, t1), $panel the days.

    Counts of starts and ends give the concurrency as a running sum, and its prefix sums the mean over any life:
    linear in rows, without a range join.
    """
    run = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    before = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return Template(f"""
WITH s AS (SELECT ticker, t0 AS date, count(*) AS n FROM $events GROUP BY ticker, t0),
f AS (SELECT ticker, t1 AS date, count(*) AS n FROM $events GROUP BY ticker, t1),
d AS (SELECT p.ticker, p.date, coalesce(s.n, 0) AS s, coalesce(f.n, 0) AS f, row_number() OVER (PARTITION BY p.ticker ORDER BY p.date) AS i
  FROM (SELECT ticker, date FROM $panel) p LEFT JOIN s ON p.ticker = s.ticker AND p.date = s.date LEFT JOIN f ON p.ticker = f.ticker AND p.date = f.date),
c AS (SELECT ticker, date, i, sum(s) {run} - coalesce(sum(f) {before}, 0) AS c FROM d),
p AS (SELECT ticker, date, i, c, sum(c) {run} AS total FROM c),
w AS (SELECT e.ticker, e.t0, (b.i - a.i + 1) / CAST(b.total - a.total + a.c AS DOUBLE) AS w FROM $events e
  JOIN p a ON e.ticker = a.ticker AND e.t0 = a.date JOIN p b ON e.ticker = b.ticker AND e.t1 = b.date)
SELECT ticker, t0, round(w / sum(w) OVER (PARTITION BY ticker), 9) AS weight FROM w""")


def stage_one() -> Template:
    return Template("SELECT ticker, t0, CASE WHEN barrier_side <> 0 THEN 1 ELSE 0 END AS label FROM $events")


def stage_two(threshold: float = 0.65) -> Template:
    """Direction of touched events whose stage-one probability in $probs (ticker, date, p1) exceeds the threshold."""
    return Template(f"""SELECT e.ticker, e.t0, CASE WHEN barrier_side > 0 THEN 1 ELSE 0 END AS label
FROM $events e LEFT JOIN $probs q ON e.ticker = q.ticker AND e.t0 = q.date WHERE p1 > {threshold} AND barrier_side <> 0""")


def meta_labels(threshold: float = 0.65) -> Template:
    return Template(f"""SELECT e.ticker, e.t0, CASE WHEN p1 > {threshold} AND barrier_side <> 0 THEN CASE WHEN barrier_side > 0 THEN 1 ELSE -1 END END AS meta
FROM $events e LEFT JOIN $probs q ON e.ticker = q.ticker AND e.t0 = q.date""")


def training_set(features: list[str]) -> Template:
    cols = ", ".join(f"p.{f}" for f in features)
    return Template(f"SELECT e.ticker, e.t0, e.label, {cols} FROM $events e JOIN $panel p ON e.ticker = p.ticker AND e.t0 = p.date")


def bet_size(threshold: float = 0.65, most: float = 1.0) -> Template:
    return Template(f"SELECT ticker, date, round(CASE WHEN p1 < {threshold} THEN 0 ELSE least(p1 * abs(p2 - 0.5) * 2, {most}) END, 8) AS size FROM $probs")


def purged_split(train_end: str, test_start: str) -> Template:
    return Template(f"""SELECT ticker, t0, CASE WHEN t0 >= DATE '{test_start}' THEN 'test' ELSE 'train' END AS part FROM $events
WHERE t0 >= DATE '{test_start}' OR (t0 <= DATE '{train_end}' AND t1 < DATE '{test_start}')""")


def quality_report() -> Template:
    """Shares of labels and of barrier sides, mean days and returns, and flags for rare classes (an occurring label, 0 too,
    of under a tenth) or too many time exits."""
    return Template("""
WITH a AS (SELECT ticker, count(*) AS n, avg(CASE WHEN label = 1 THEN 1e0 ELSE 0e0 END) AS up, avg(CASE WHEN label = -1 THEN 1e0 ELSE 0e0 END) AS down,
  avg(CASE WHEN label = 0 THEN 1e0 ELSE 0e0 END) AS flat, avg(CASE WHEN barrier_side = 1 THEN 1e0 ELSE 0e0 END) AS upper_touches,
  avg(CASE WHEN barrier_side = -1 THEN 1e0 ELSE 0e0 END) AS lower_touches, avg(CASE WHEN barrier_side = 0 THEN 1e0 ELSE 0e0 END) AS time_exits,
  avg(days_held) AS days, avg(return_at_touch) AS mean_ret, stddev_samp(return_at_touch) AS sd_ret FROM $events GROUP BY ticker)
SELECT ticker, n, round(up, 6) AS up, round(down, 6) AS down, round(flat, 6) AS flat, round(upper_touches, 6) AS upper_touches, round(lower_touches, 6) AS lower_touches, round(time_exits, 6) AS time_exits, round(days, 6) AS days,
  round(mean_ret, 7) + 0.0 AS mean_ret, round(sd_ret, 7) AS sd_ret, (up > 0 AND up < 0.1) OR (down > 0 AND down < 0.1) OR (flat > 0 AND flat < 0.1) AS rare_class, time_exits > 0.5 AS slow FROM a""")


def look_ahead_check() -> Template:
    """How many events start on a day that has features, and how many end before they start (none should)."""
    return Template("""SELECT e.ticker, count(*) AS n_events, sum(CASE WHEN p.date IS NOT NULL THEN 1 ELSE 0 END) AS with_features,
  sum(CASE WHEN e.t1 < e.t0 THEN 1 ELSE 0 END) AS backwards FROM $events e LEFT JOIN $panel p ON e.ticker = p.ticker AND e.t0 = p.date GROUP BY e.ticker""")
