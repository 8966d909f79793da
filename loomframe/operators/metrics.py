"""Signal, return and acceptance metrics. $scored has (ticker, date, signal, fwd, sector), $daily (date, ret)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.functions.ordered import average_ranks
from loomframe.functions.template import Template

from .xsection import quantile_buckets


def average_rank(x: str, by: str = "date") -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2e0"


def _ic(group: str, x: str = "signal", y: str = "fwd", least: int = 10, spearman: bool = True, src: str = "$scored") -> str:
    """Correlation per group on rows where both are there; null under `least` pairs or without spread."""
    rank = lambda v: f"{average_rank(v, group)}" if spearman else v
    return f"""SELECT {group}, CASE WHEN count(*) >= {least} AND max(a) > min(a) AND max(b) > min(b) THEN corr(a, b) END AS ic
FROM (SELECT {group}, {rank(x)} AS a, {rank(y)} AS b FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) r GROUP BY {group}"""


def pooled_ic(spearman: bool = True) -> Template:
    return Template(f"SELECT ticker, round(ic, 6) + 0.0 AS ic FROM ({_ic('ticker', spearman=spearman)}) q")


def whole_ic(scored: DataFrame) -> DataFrame:
    """(n, ic): one rank correlation over all known pairs of the panel, whatever their date and ticker; null without spread.

    The ranks come from ranges of the values (average_ranks), so that no task orders the panel.
    """
    known = scored.where("signal IS NOT NULL AND fwd IS NOT NULL").select("signal", "fwd")
    ranked = average_ranks(known, {"signal": "a", "fwd": "b"})
    spread = (F.max("a") > F.min("a")) & (F.max("b") > F.min("b"))
    return ranked.agg(F.count(F.lit(1)).alias("n"), (F.round(F.when(spread, F.corr("a", "b")), 7) + 0.0).alias("ic"))


def daily_ic(spearman: bool = True) -> Template:
    return Template(f"SELECT date, round(ic, 6) + 0.0 AS ic FROM ({_ic('date', spearman=spearman)}) q")


YEAR = "sqrt(252e0)"
ICIR = f"CASE WHEN count(ic) >= 10 AND max(ic) > min(ic) THEN avg(ic) / stddev_samp(ic) * {YEAR} END"


def sharpe(r: str = "ret", rf: float = 0.0) -> str:
    return f"CASE WHEN count({r}) >= 10 AND max({r}) > min({r}) THEN (avg({r}) - {rf / 252!r}) / stddev_samp({r}) * {YEAR} END"


def icir() -> Template:
    return Template(f"SELECT round(avg(ic), 7) AS mean_ic, round({ICIR}, 5) AS icir, count(ic) AS n FROM ({_ic('date')}) q")


def sharpe_ratio(rf: float = 0.0) -> Template:
    return Template(f"SELECT round({sharpe('ret', rf)}, 5) AS sharpe FROM $daily")


SO_FAR = "OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def growth(over: str = SO_FAR) -> str:
    """Product of 1 + ret: by logarithms, with a total loss (0) and losses beyond it (a change of sign) counted apart."""
    lost, sign = f"sum(CASE WHEN ret = -1 THEN 1 ELSE 0 END) {over}", f"sum(CASE WHEN ret < -1 THEN 1 ELSE 0 END) {over}"
    return f"CASE WHEN {lost} > 0 THEN 0e0 ELSE exp(coalesce(sum(ln(nullif(abs(1 + ret), 0))) {over}, 0)) * (1 - 2 * ({sign} % 2)) END"


CUM = growth()
PEAK = f"max(cum) {SO_FAR}"


def _drawdown(peak: str = PEAK) -> str:
    """One ordered pass over the dates: a row a day, whatever the size of the panel."""
    return f"SELECT date, ret, cum, cum / {peak} - 1 AS dd FROM (SELECT date, ret, {CUM} AS cum FROM $daily) c"


def max_drawdown(from_one: bool = False) -> Template:
    peak = f"greatest(1e0, {PEAK})" if from_one else PEAK
    return Template(f"SELECT round(CASE WHEN count(*) < 2 THEN 0 ELSE min(dd) END, 7) + 0.0 AS max_drawdown FROM ({_drawdown(peak)}) d")


def dated(src: str, by: str = "") -> str:
    """CTE `days`: the distinct dates of src with their position i and number n, for each run where `by` ("split_id, ")
    tells runs apart. A row a date, so that one task orders the dates of a run."""
    part = f"PARTITION BY {by.rstrip(', ')}" if by else ""
    return f"days AS (SELECT {by}date, row_number() OVER ({part} ORDER BY date) - 1 AS i, count(*) OVER ({part}) AS n FROM (SELECT DISTINCT {by}date FROM {src}) u)"


def _turnover(src: str = "$weights", by: str = "") -> str:
    """CTEs after `days` to `turned` (date, turnover): half the sum of absolute weight changes from one date of src to the next.

    No row is a weight of 0, so a name that was not there the date before enters with its whole weight, and one that is not
    there the date after leaves with it: rows say so themselves, and no dates x names grid is made. 0 on the first date.
    """
    o = f"OVER (PARTITION BY {by}ticker ORDER BY i)"
    return f"""
placed AS (SELECT {by}ticker, weight, i, n, lag(weight) {o} AS w0, lag(i) {o} AS i0, lead(i) {o} AS i1 FROM {src} w JOIN days USING ({by}date)),{_turned('placed', by)}"""


def _turned(src: str, by: str = "") -> str:
    """CTEs from rows with the positions and weight of their neighbours to `turned`."""
    return f"""
moves AS (SELECT {by}i, abs(coalesce(weight, 0) - CASE WHEN i0 = i - 1 THEN coalesce(w0, 0) ELSE 0 END) AS ch FROM {src} WHERE i > 0
  UNION ALL SELECT {by}i + 1 AS i, abs(weight) FROM {src} WHERE weight <> 0 AND coalesce(i1, -1) <> i + 1 AND i + 1 < n),
turned AS (SELECT {by}date, coalesce(sum(ch), 0) / 2 AS turnover FROM days LEFT JOIN moves USING ({by}i) GROUP BY {by}date)"""


def turnover() -> Template:
    """Half the sum of absolute weight changes a day, with 0 for no weight; 0 on the first day."""
    return Template(f"WITH {dated("$weights")},{_turnover()} SELECT date, round(turnover, 10) + 0.0 AS turnover FROM turned")


def summary(bps: float = 7.5) -> Template:
    """All metrics of a signal, its daily returns and its weights in one row.

    Signals, returns and weights are each summed to a row a date, once; the rows of a date meet in one aggregate. The p-value of
    the mean IC follows from ic_t_stat and ic_days by student_p_value (with_p_value()).
    """
    over = SO_FAR
    o = "OVER (PARTITION BY ticker ORDER BY date)"
    return Template(f"""
WITH ic AS ({_ic('date')}),
near AS (SELECT date, weight, lag(weight) {o} AS w0, lag(date) {o} AS d0, lead(date) {o} AS d1 FROM $weights),
ahead AS (SELECT date, d0, d1, sum(abs(coalesce(weight, 0) - coalesce(w0, 0))) AS changed, sum(abs(coalesce(weight, 0))) AS whole FROM near GROUP BY date, d0, d1),
held AS (SELECT date, collect_list(named_struct('d0', d0, 'd1', d1, 'changed', changed, 'whole', whole)) AS moves FROM ahead GROUP BY date),
shifted AS (SELECT date, moves, lag(date) OVER (ORDER BY date) AS before, lead(date) OVER (ORDER BY date) AS after FROM held),
parts AS (SELECT date, before, aggregate(moves, 0e0, (s, m) -> s + CASE WHEN m.d0 = before THEN m.changed ELSE m.whole END) AS entered,
  aggregate(moves, 0e0, (s, m) -> s + CASE WHEN m.d1 = after THEN 0e0 ELSE m.whole END) AS leaves FROM shifted),
turned AS (SELECT date, CASE WHEN before IS NULL THEN 0e0 ELSE (entered + coalesce(lag(leaves) OVER (ORDER BY date), 0)) / 2 END AS turnover FROM parts),
every AS (SELECT date, true AS rated, ic, false AS earned, CAST(NULL AS DOUBLE) AS ret, CAST(NULL AS DOUBLE) AS turnover FROM ic
  UNION ALL SELECT date, false, NULL, true, ret, NULL FROM $daily UNION ALL SELECT date, false, NULL, false, NULL, turnover FROM turned),
day AS (SELECT date, max(rated) AS rated, max(ic) AS ic, max(earned) AS earned, max(ret) AS ret, max(turnover) AS turnover FROM every GROUP BY date),
cum AS (SELECT *, CASE WHEN earned THEN {growth(over)} END AS cum, CASE WHEN earned THEN ret - coalesce(turnover, 0) * {bps} / 10000 END AS net FROM day),
dd AS (SELECT *, cum / max(cum) {over} - 1 AS dd FROM cum),
f AS (SELECT avg(ic) AS mean_ic, {ICIR} AS icir, count(ic) AS ic_days, avg(CASE WHEN round(ic, 12) > 0 THEN 1e0 ELSE 0e0 END) FILTER (WHERE rated) AS hit,
  avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(CAST(count(ic) AS DOUBLE)) AS t_stat, {sharpe('net')} AS net_sharpe, avg(turnover) AS turnover,
  count(*) FILTER (WHERE earned) AS days, {sharpe()} AS sharpe, max_by(cum, date) FILTER (WHERE earned) - 1 AS total,
  power(max_by(cum, date) FILTER (WHERE earned), 252e0 / count(*) FILTER (WHERE earned)) - 1 AS annual, min(dd) AS mdd, stddev_samp(ret) * {YEAR} AS vol,
  avg(CASE WHEN ret > 0 THEN 1e0 ELSE 0e0 END) FILTER (WHERE earned) AS win FROM dd)
SELECT round(mean_ic, 7) AS mean_ic, round(icir, 5) AS icir, round(hit, 6) AS ic_hit_rate, ic_days, round(t_stat, 7) AS ic_t_stat, round(sharpe, 5) AS gross_sharpe,
  round(net_sharpe, 5) AS net_sharpe, days AS n_days, round(turnover, 8) AS mean_turnover, round(turnover * {bps} / 10000, 12) AS turnover_cost,
  round(total, 5) AS total_return, round(annual, 6) AS annualized_return, round(mdd, 6) AS max_drawdown, round(vol, 6) AS volatility,
  round(CASE WHEN mdd <> 0 THEN annual / abs(mdd) ELSE 0 END, 5) AS calmar, round(win, 6) AS win_rate FROM f""")


def with_p_value(summarised: DataFrame) -> DataFrame:
    """The summary's one row with ic_pvalue, the two-sided p-value of its mean IC."""

    @F.pandas_udf("double")
    def p(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([student_p_value(float(a), int(b)) if a == a else None for a, b in zip(t, n, strict=True)], dtype="float64")

    return summarised.withColumn("ic_pvalue", F.round(p("ic_t_stat", "ic_days"), 6))


def ic_decay(horizons=(1, 5, 10, 21)) -> Template:
    """Mean, deviation and ratio of the daily IC against the return of each horizon; $multi has fwd_{h}."""
    parts = [f"SELECT {h} AS horizon, ic FROM ({_ic('date', y=f'fwd_{h}').replace('$scored', '$multi')}) q{h}" for h in horizons]
    return Template(f"""SELECT horizon, round(avg(ic), 7) AS mean_ic, round(stddev_samp(ic), 7) AS std_ic, round({ICIR}, 5) AS icir
FROM ({' UNION ALL '.join(parts)}) u GROUP BY horizon""")


def quantile_returns(n: int = 10) -> Template:
    """Mean of daily mean returns and of daily numbers of names a quantile (1 is the lowest), and the spread of the last
    over the first.

    A date counts where at least n names have a return; a quantile without names there counts 0 names and no return.
    """
    b = quantile_buckets("signal", n, extra="fwd").replace("$panel", "known")
    return Template(f"""
WITH known AS (SELECT * FROM $panel WHERE signal IS NOT NULL AND fwd IS NOT NULL),
d AS (SELECT date, bucket + 1 AS quantile, avg(fwd) AS r, count(*) AS k FROM ({b}) b WHERE bucket IS NOT NULL GROUP BY date, bucket),
t AS (SELECT count(DISTINCT date) AS dates FROM d),
m AS (SELECT quantile, avg(r) AS r, count(*) AS days, sum(k) AS k FROM d GROUP BY quantile)
SELECT quantile, round(r, 8) + 0.0 AS mean_return, days, round(k / CAST(dates AS DOUBLE), 6) AS n_stocks,
  round(ARGMAX(r, quantile) OVER () - ARGMIN(r, quantile) OVER (), 8) + 0.0 AS spread FROM m CROSS JOIN t""")


def sector_ic(least: int = 10) -> Template:
    """Mean daily IC and its ratio a sector; a date counts where the sector has `least` known pairs."""
    rank = lambda v: average_rank(v, "date, sector")
    return Template(f"""
WITH r AS (SELECT date, sector, {rank('signal')} AS a, {rank('fwd')} AS b FROM $scored WHERE signal IS NOT NULL AND fwd IS NOT NULL),
d AS (SELECT date, sector, CASE WHEN count(*) >= {least} AND max(a) > min(a) AND max(b) > min(b) THEN corr(a, b) END AS ic FROM r GROUP BY date, sector),
n AS (SELECT sector, count(DISTINCT ticker) AS n_stocks FROM $scored GROUP BY sector)
SELECT d.sector, round(avg(ic), 7) + 0.0 AS mean_ic, round({ICIR}, 5) + 0.0 AS icir, count(ic) AS days, max(n_stocks) AS n_stocks FROM d JOIN n ON d.sector = n.sector GROUP BY d.sector""")


def rolling_metrics(k: int = 252) -> Template:
    w = f"OVER (ORDER BY date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    full = lambda c, e: f"CASE WHEN count({c}) {w} = {k} THEN {e} END"
    return Template(f"""
WITH c AS (SELECT date, ret, {CUM} AS cum FROM $daily), d AS (SELECT *, {full('cum', f'cum / max(cum) {w} - 1')} AS dd FROM c)
SELECT date, round({full('ret', f'avg(ret) {w} * 252')}, 7) + 0.0 AS mean_return, round({full('ret', f'stddev_samp(ret) {w} * {YEAR}')}, 7) AS volatility,
  round({full('ret', f'avg(ret) {w} * 252 / nullif(stddev_samp(ret) {w} * {YEAR}, 0)')}, 5) + 0.0 AS sharpe, round({full('dd', f'min(dd) {w}')}, 7) + 0.0 AS max_drawdown FROM d""")


def sharpe_variants() -> Template:
    """Population deviation with a small addend, population deviation with a zero guard, sample deviation with one."""
    return Template(f"""SELECT round(avg(ret) / (stddev_pop(ret) + 1e-10) * {YEAR}, 5) AS sharpe_eps,
  round(CASE WHEN stddev_pop(ret) > 0 THEN avg(ret) / stddev_pop(ret) * {YEAR} ELSE 0 END, 5) AS sharpe_pop,
  round(CASE WHEN stddev_samp(ret) < 1e-10 THEN 0 ELSE avg(ret) / stddev_samp(ret) * {YEAR} END, 5) AS sharpe_samp FROM $daily""")


def ordinal_ic() -> Template:
    """Correlation of ordinal ranks (ties by ticker) a day, 0 without spread."""
    rank = lambda v: f"row_number() OVER (PARTITION BY date ORDER BY {v}, ticker)"
    return Template(f"""SELECT date, round(CASE WHEN count(*) < 2 THEN 0 ELSE corr(a, b) END, 6) + 0.0 AS ic FROM (
  SELECT date, CAST({rank('signal')} AS DOUBLE) AS a, CAST({rank('fwd')} AS DOUBLE) AS b FROM $scored WHERE signal IS NOT NULL AND fwd IS NOT NULL) r GROUP BY date""")


def strategy_return() -> Template:
    return Template("""SELECT date, round(sum(sign(signal) * fwd), 9) + 0.0 AS total, round(avg(CASE WHEN sign(signal) * fwd > 0 THEN 1e0 ELSE 0e0 END), 7) AS win_rate
FROM $scored WHERE signal IS NOT NULL AND fwd IS NOT NULL GROUP BY date""")


def ic_monitor(floor: float = 0.03, run: int = 3) -> Template:
    """Daily IC with an alert where the last `run` known values all lie under the floor."""
    w = f"OVER (ORDER BY date ROWS BETWEEN {run - 1} PRECEDING AND CURRENT ROW)"
    return Template(f"""SELECT date, round(ic, 6) + 0.0 AS ic, count(*) {w} = {run} AND max(round(ic, 9)) {w} < {floor} AS alert FROM ({_ic('date')}) q WHERE ic IS NOT NULL""")


def acceptance_gate() -> Template:
    """Thresholds on the one-row result of a run: $run (mean_ic, icir, net_sharpe, max_drawdown, mean_turnover)."""
    tests = {"ic_ok": "mean_ic > 0.055", "icir_ok": "icir > 0.9", "sharpe_ok": "net_sharpe > 1.8", "drawdown_ok": "abs(max_drawdown) < 0.22", "turnover_ok": "mean_turnover < 0.18"}
    return Template(f"SELECT {', '.join(f'{e} AS {c}' for c, e in tests.items())}, {' AND '.join(tests.values())} AS accepted FROM $run")


def student_p_value(t: float, n: int) -> float:
    """Two-sided p-value of a one-sample t statistic, from the incomplete beta function's continued fraction."""
    df = n - 1
    if df < 1 or t != t:
        return float("nan")
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0

    def fraction(a: float, b: float, x: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d or tiny)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + num * d) or tiny)
                c = (1 + num / c) or tiny
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b
