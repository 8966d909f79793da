"""Long/short backtest and cost models. $scored has (ticker, date, signal, ret, fwd, adv, sector).

A run is one chain of CTEs; `by` ("split_id, ") leads every partitioning where several runs share one job.
"""

from __future__ import annotations

from loomframe.functions.template import Template

from .metrics import YEAR, average_rank, dated, growth, sharpe
from .xsection import percent_rank

CAPITAL = 1e7
#: Largest position as a share of a name's average daily dollar volume.
SHARE = 0.05
#: Basis points of impact of a trade of a million in a name that trades as much a day.
KAPPA = 0.1


def align() -> Template:
    """Rows whose date and ticker occur with a signal and with a return: semi-joins on keys, not on cells."""
    return Template("""SELECT ticker, date, round(signal, 7) AS signal, fwd FROM $scored
WHERE date IN (SELECT date FROM $scored WHERE signal IS NOT NULL) AND date IN (SELECT date FROM $scored WHERE fwd IS NOT NULL)
  AND ticker IN (SELECT ticker FROM $scored WHERE signal IS NOT NULL)""")


def _day(by: str, more: str = "") -> str:
    return f"OVER (PARTITION BY {by}date{more})"


def _weights(cut: float = 0.1, by: str = "", src: str = "$scored") -> str:
    day = _day(by)
    return f"""
ranked AS (SELECT *, round({percent_rank('signal', by)}, 9) AS r, count(signal) {day} AS names FROM {src}),
sided AS (SELECT *, CASE WHEN r IS NULL OR names < 10 THEN NULL WHEN r >= {1 - cut} THEN 1 WHEN r <= {cut} THEN -1 ELSE 0 END AS side FROM ranked),
target AS (SELECT *, CASE WHEN side = 1 THEN 1e0 / sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) {day}
  WHEN side = -1 THEN -1e0 / sum(CASE WHEN side = -1 THEN 1 ELSE 0 END) {day} WHEN side = 0 THEN 0e0 END AS w1 FROM sided)"""


def _capped(share: float, capital: float) -> str:
    return f"""
capped AS (SELECT *, CASE WHEN abs(w1) * {capital} > adv * {share} AND adv > 0 THEN w1 * (adv * {share}) / (abs(w1) * {capital}) ELSE w1 END AS w2 FROM target)"""


def _neutral(by: str = "") -> str:
    s = _day(by, ", sector")
    return f"""
neutral AS (SELECT *, CASE WHEN abs(sum(w2) {s}) > 0.01 THEN w2 - sum(w2) {s} / count(w2) {s} ELSE w2 END AS w3 FROM capped)"""


def _normal(by: str = "") -> str:
    long, short = f"sum(CASE WHEN w3 > 0 THEN w3 END) {_day(by)}", f"sum(CASE WHEN w3 < 0 THEN -w3 END) {_day(by)}"
    return f"""
normal AS (SELECT *, CASE WHEN w3 > 0 THEN w3 / {long} WHEN w3 < 0 THEN w3 / {short} ELSE w3 END AS weight FROM neutral)"""


def chain(share: float = SHARE, capital: float = CAPITAL, by: str = "", src: str = "$scored") -> str:
    """CTEs from signals to final weights; each level is a window over the date, so one exchange serves all."""
    return ",".join((_weights(by=by, src=src), _capped(share, capital), _neutral(by), _normal(by)))


def target_weights() -> Template:
    return Template(f"WITH {_weights()} SELECT ticker, date, round(w1, 8) + 0.0 AS weight FROM target")


def capped_weights(share: float = SHARE, capital: float = CAPITAL) -> Template:
    return Template(f"WITH {_weights()},{_capped(share, capital)} SELECT ticker, date, round(w2, 11) + 0.0 AS weight FROM capped")


def neutral_weights(share: float = SHARE, capital: float = CAPITAL) -> Template:
    return Template(f"WITH {_weights()},{_capped(share, capital)},{_neutral()} SELECT ticker, date, round(w3, 11) + 0.0 AS weight FROM neutral")


def final_weights(share: float = SHARE, capital: float = CAPITAL) -> Template:
    return Template(f"WITH {chain(share, capital)} SELECT ticker, date, sector, round(weight, 8) + 0.0 AS weight FROM normal")


def daily_book(bps: float = 7.5, kappa: float = KAPPA, share: float = SHARE, capital: float = CAPITAL, by: str = "", src: str = "$scored") -> str:
    """CTEs down to `daily`: gross return, one-way turnover, trading and impact cost a day.

    Weights earn the return of the next date of the run and change against the date before; a name without a row on the
    date before neither earns nor trades there. Neighbouring dates meet by their positions, so no dates x names grid is
    made. A day on which a traded name has no known adv has no known impact, and so no net return.
    """
    o = f"OVER (PARTITION BY {by}ticker ORDER BY i)"
    value = f"abs(weight - held) * {capital}"
    impact = f"{value} * {kappa} / 10000 * sqrt({value} / 1e6) * sqrt({value} / (CASE WHEN adv > 0 THEN adv ELSE CAST(0 AS DOUBLE) END + 1e-10))"
    return f"""{chain(share, capital, by, src)},
book AS (SELECT {by}ticker, date, weight, adv, ret FROM normal), {dated(src, by)},
near AS (SELECT {by}ticker, date, weight, adv, ret, i, n, lag(weight) {o} AS w0, lag(i) {o} AS i0, lead(i) {o} AS i1 FROM book JOIN days USING ({by}date)),
moved AS (SELECT *, CASE WHEN i0 = i - 1 THEN w0 END AS held FROM near),
daily AS (SELECT {by}date, coalesce(sum(held * ret), 0) AS gross, coalesce(sum(abs(weight - held)), 0) / 2 AS traded,
  coalesce(sum(abs(weight - held)), 0) / 2 * {bps} / 10000 AS cost,
  CASE WHEN count(CASE WHEN held IS NOT NULL AND weight IS NOT NULL AND adv IS NULL THEN 1 END) = 0 THEN coalesce(sum({impact}), 0) / {capital} END AS impact
  FROM moved GROUP BY {by}date)"""


def gross_returns() -> Template:
    return Template(f"WITH {daily_book()} SELECT date, round(gross, 7) + 0.0 AS gross FROM daily")


def trading_costs(bps: float = 7.5) -> Template:
    return Template(f"WITH {daily_book(bps)} SELECT date, round(traded, 7) AS traded, round(cost, 10) AS cost FROM daily")


def impact_costs(kappa: float = KAPPA) -> Template:
    return Template(f"WITH {daily_book(kappa=kappa)} SELECT date, round(impact, 10) AS impact FROM daily")


def _run(returns: str, by: str = "", src: str = "$scored") -> str:
    """CTEs down to `fig`: one row a run with its gross, cost, net, IC and turnover figures.

    One chain without a branch: windows by date (weights and IC ranks), windows by ticker (the dates before and after), one
    aggregate to a row a date, windows over these, one aggregate to a row a run. Only the dates' positions are a second
    scan, of one column. Turnover is as in metrics.turnover(): what enters or changes on a date, and what was there the date
    before only.
    """
    run = by.rstrip(", ")
    over = f"OVER ({f'PARTITION BY {run} ' if by else ''}ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    group = f" GROUP BY {run}" if by else ""
    known = "FILTER (WHERE ret IS NOT NULL)"
    o = f"OVER (PARTITION BY {by}ticker ORDER BY i)"
    value = f"abs(weight - held) * {CAPITAL}"
    impact = f"{value} * {KAPPA} / 10000 * sqrt({value} / 1e6) * sqrt({value} / (CASE WHEN adv > 0 THEN adv ELSE CAST(0 AS DOUBLE) END + 1e-10))"
    rank = lambda x: f"CASE WHEN paired THEN {average_rank(x, f'{by}date, paired')} END"
    return f"""
pairs AS (SELECT *, signal IS NOT NULL AND {returns} IS NOT NULL AS paired FROM {src}),
ordered AS (SELECT *, {rank('signal')} AS rank_s, {rank(returns)} AS rank_r FROM pairs),{chain(by=by, src='ordered')}, {dated(src, by)},
near AS (SELECT {by}date, weight, adv, ret, rank_s, rank_r, i, n, lag(weight) {o} AS w0, lag(i) {o} AS i0, lead(i) {o} AS i1 FROM normal JOIN days USING ({by}date)),
moved AS (SELECT *, CASE WHEN i0 = i - 1 THEN w0 END AS held FROM near),
daily AS (SELECT {by}date, coalesce(sum(held * ret), 0) AS gross, coalesce(sum(abs(weight - held)), 0) / 2 * 7.5 / 10000 AS cost,
  CASE WHEN count(CASE WHEN held IS NOT NULL AND weight IS NOT NULL AND adv IS NULL THEN 1 END) = 0 THEN coalesce(sum({impact}), 0) / {CAPITAL} END AS impact,
  CASE WHEN count(rank_s) >= 10 AND max(rank_s) > min(rank_s) AND max(rank_r) > min(rank_r) THEN corr(rank_s, rank_r) END AS ic,
  CASE WHEN i > 0 THEN sum(abs(coalesce(weight, 0) - coalesce(held, 0))) ELSE 0 END AS moved,
  sum(CASE WHEN weight <> 0 AND coalesce(i1, -1) <> i + 1 THEN abs(weight) ELSE 0 END) AS leaves
  FROM moved GROUP BY {by}date, i),
net AS (SELECT *, gross - (cost + impact) AS ret, cost + impact AS paid, (moved + coalesce(lag(leaves) {over.split(' ROWS')[0]}), 0)) / 2 AS turnover FROM daily),
cum AS (SELECT *, CASE WHEN ret IS NOT NULL THEN {growth(over)} END AS cum FROM net),
dd AS (SELECT *, cum / max(cum) {over} - 1 AS dd FROM cum),
fig AS (SELECT {by}count(*) AS days, {sharpe('gross')} AS gross_sharpe, sum(paid) AS total_costs, avg(paid) AS avg_daily_cost,
  {sharpe()} AS net_sharpe, CASE WHEN count(ret) < 2 THEN 0 ELSE min(dd) END AS max_drawdown, max_by(cum, date) {known} - 1 AS total_return,
  power(max_by(cum, date) {known}, 252e0 / count(ret)) - 1 AS annualized_return, stddev_samp(ret) * {YEAR} AS volatility,
  avg(ic) AS mean_ic, CASE WHEN stddev_samp(ic) > 0 THEN avg(ic) / stddev_samp(ic) * {YEAR} ELSE 0 END AS icir, avg(turnover) AS mean_turnover FROM dd{group})"""


CALMAR = "CASE WHEN max_drawdown <> 0 THEN annualized_return / abs(max_drawdown) ELSE 0 END"
RESULT = {
    "gross_sharpe": 4, "net_sharpe": 4, "max_drawdown": 6, "mean_turnover": 7, "total_return": 6, "annualized_return": 6, "volatility": 7,
    "mean_ic": 7, "icir": 4, "total_costs": 8, "avg_daily_cost": 11,
}


def _figures() -> str:
    return ", ".join([f"round({c}, {n}) + 0.0 AS {c}" for c, n in RESULT.items()] + [f"round({CALMAR}, 5) + 0.0 AS calmar_ratio"])


def result(returns: str = "ret") -> Template:
    """One row: Sharpe ratios, drawdown, turnover, returns, IC and costs of a run. The IC is the signal's with the same
    returns that the weights of the date before earn."""
    return Template(f"WITH {_run(returns)} SELECT days, {_figures()} FROM fig")


def positions(capital: float = CAPITAL) -> Template:
    """Dollar positions of a run and what each gains a day: the weight of the date before times the return, in dollars."""
    return Template(f"""WITH {daily_book(capital=capital)}
SELECT ticker, date, round(weight * {capital}, 3) + 0.0 AS position, round(held * ret * {capital}, 3) + 0.0 AS pnl FROM moved WHERE weight IS NOT NULL""")


def walk_forward(returns: str = "ret") -> Template:
    """A whole run for each split of $splits (split_id, lo, hi) over the split's dates, with means over splits and the
    population deviation of their net Sharpe ratios.

    All runs are one job. The few splits meet the dates, a row a date, and panel rows meet their splits by equal dates.
    """
    own = """cal AS (SELECT DISTINCT date FROM $scored), member AS (SELECT s.split_id, c.date FROM cal c JOIN $splits s ON c.date BETWEEN s.lo AND s.hi),
own AS (SELECT m.split_id, p.* FROM $scored p JOIN member m ON p.date = m.date)"""
    over = {"mean_net_sharpe": ("avg(net_sharpe)", 4), "std_net_sharpe": ("stddev_pop(net_sharpe)", 4), "mean_ic_of_splits": ("avg(mean_ic)", 7), "mean_turnover_of_splits": ("avg(mean_turnover)", 7), "mean_drawdown": ("avg(max_drawdown)", 6)}
    means = ", ".join(f"round({e} OVER (), {n}) + 0.0 AS {c}" for c, (e, n) in over.items())
    # The positions of a split's dates come from the calendar alone: every one of its dates has rows.
    run = _run(returns, "split_id, ", "own").replace("FROM (SELECT DISTINCT split_id, date FROM own) u", "FROM member u")
    return Template(f"WITH {own},{run} SELECT split_id, days, {_figures()}, {means} FROM fig")


TRADES = "SELECT ticker, date, close * volume AS value, adv, vol FROM $trades"


def _impact(value: str = "value", adv: str = "adv", kappa: float = KAPPA) -> str:
    return f"CASE WHEN {adv} > 0 THEN {value} * {kappa} * sqrt({value} / 1e6) * sqrt({value} / {adv}) / 10000 ELSE 0 END"


def transaction_costs(fixed: float = 0.0, bps: float = 7.5, spread: float = 2.0, kappa: float = KAPPA) -> Template:
    """Fixed, commission, half spread and square-root impact of each trade in $trades (value, adv)."""
    return Template(f"""WITH t AS ({TRADES}), c AS (SELECT ticker, date, {fixed}e0 + value * {bps} / 10000 AS commission, value * {spread} / 10000 AS spread, {_impact(kappa=kappa)} AS impact FROM t)
SELECT ticker, date, round(commission, 9) AS commission, round(spread, 9) AS spread, round(impact, 9) AS impact, round(commission + spread + impact, 8) AS total FROM c""")


def portfolio_costs(bps: float = 7.5, spread: float = 2.0, kappa: float = KAPPA) -> Template:
    """Cost parts of signed trades $trades (ticker, trade_value); $volumes (ticker, adv) may lack a name, which then has no impact."""
    return Template(f"""
WITH t AS (SELECT t.ticker, abs(trade_value) AS value, adv FROM $trades t LEFT JOIN $volumes v ON t.ticker = v.ticker),
c AS (SELECT ticker, value, value * {bps} / 10000 AS fixed_cost, value * {spread} / 10000 AS spread_cost, {_impact(kappa=kappa)} AS impact_cost FROM t)
SELECT ticker, round(value, 4) AS trade_value, round(fixed_cost, 8) AS fixed_cost, round(spread_cost, 8) AS spread_cost, round(impact_cost, 8) AS impact_cost,
  round(fixed_cost + spread_cost + impact_cost, 8) AS total_cost FROM c""")


def market_impact(kappa: float = KAPPA) -> Template:
    return Template(f"WITH t AS ({TRADES}), i AS (SELECT ticker, date, {_impact(kappa=kappa)} AS i FROM t) SELECT ticker, date, round(i * 0.8, 9) AS temporary, round(i * 0.2, 9) AS permanent FROM i")


def twap(n: int = 10) -> Template:
    return Template(f"SELECT ticker, date, slice, round(value / {n}, 6) AS value FROM ({TRADES}) t CROSS JOIN (SELECT INTSEQ(1, {n}) AS slice) s")


def slippage(bps: float = 2.0) -> Template:
    return Template(f"SELECT ticker, date, round(value * {bps} / 10000 + value * vol * 0.5, 6) AS slippage FROM ({TRADES}) t")


def borrow_costs(easy: float = 0.003, hard: float = 0.1) -> Template:
    """A day's fee on short weights; names of $hard are hard to borrow."""
    return Template(f"""SELECT w.ticker, w.date, round(abs(weight) * {CAPITAL} * CASE WHEN h.ticker IS NOT NULL THEN {hard} ELSE {easy} END / 252, 9) AS fee
FROM $weights w LEFT JOIN $hard h ON w.ticker = h.ticker WHERE weight < 0""")
