"""DuckDB oracles written from the definitions, not rendered from the operators.

They share the operators' inputs (bars and the scored fixture) and rounding, and nothing else: windows are spelled out,
cross-sections are self-joins, books are dense dates x names grids, and DuckDB's own skewness, kurtosis and product
stand where the operators compose them.
"""

from __future__ import annotations

from loomframe.sources.bars import BARS_SQL

WINDOWS = "WINDOW o AS (PARTITION BY ticker ORDER BY date), " + ", ".join(
    f"w{k} AS (PARTITION BY ticker ORDER BY date ROWS {k - 1} PRECEDING)" for k in (2, 5, 10, 14, 20, 21, 50, 62, 63, 126, 200, 251, 252)
)


def whole(f: str, x: str, k: int) -> str:
    """f over the last k rows where none of them lacks x."""
    return f"if(count({x}) OVER w{k} = {k}, {f}({x}) OVER w{k}, NULL)"


def over_bars(columns: str, *steps: str) -> str:
    """Columns of the last of a chain of SELECT lists over the bars with simple returns r and log returns l."""
    chain = [f"b AS ({BARS_SQL})", f"c0 AS (SELECT *, close / lag(close) OVER o - 1 AS r, ln(close / lag(close) OVER o) AS l FROM b {WINDOWS})"]
    chain += [f"c{i + 1} AS (SELECT *, {s} FROM c{i} {WINDOWS})" for i, s in enumerate(steps)]
    return f"WITH {', '.join(chain)} SELECT ticker, date, {columns} FROM c{len(steps)} {WINDOWS}"


def _moments(k: int) -> str:
    return f"{whole('stddev_samp', 'l', k)} * sqrt(252) AS s{k}, {whole('skewness', 'l', k)} AS g{k}, {whole('kurtosis', 'l', k)} AS q{k}"


def shown(columns: dict[str, str], digits: int = 6) -> str:
    return ", ".join(f"round({e}, {digits}) + 0.0 AS {c}" for c, e in columns.items())


def _zscore(x: str, k: int) -> str:
    """Over k rows, known values alone; 0 without spread."""
    return f"if(count(*) OVER w{k} < {k}, NULL, coalesce(({x} - avg({x}) OVER w{k}) / nullif(stddev_pop({x}) OVER w{k} * (max({x}) OVER w{k} > min({x}) OVER w{k})::INT, 0), 0))"


def _annual(x: str, k: int) -> str:
    """The yearly volatility of a mean of daily variances; none of one below 0."""
    mean = whole("avg", x, k)
    return f"CASE WHEN {mean} > -5e-13 THEN sqrt(252 * greatest({mean}, 0)) END"


_YEARS = (63, 252)
_SIX = (5, 10, 21, 63, 126, 252)
_TRUE_RANGE = "greatest(high, coalesce(lag(close) OVER o, high)) - least(low, coalesce(lag(close) OVER o, low)) AS tr"
#: The population's skewness from the sample's, which is what the engine has; m known returns of k rows.
_SKEW = "skewness(r) OVER w{k} * (m{k} - 2) / sqrt(m{k} * (m{k} - 1))"
_FLAT = "max(r) OVER w{k} = min(r) OVER w{k}"
TECHNICAL = {
    "t01_cum_returns": over_bars(shown({f"cum_ret_{k}d": whole("sum", "r", k) for k in _SIX})),
    "t02_return_zscores": over_bars(shown({f"ret_zscore_{k}d": _zscore("r", k) for k in _SIX} | {f"volume_zscore_{k}d": _zscore("volume", k) for k in (21, 63)}, 5)),
    "t03_skewness": over_bars(
        shown({f"skewness_{k}d": f"if(count(*) OVER w{k} < {k} OR m{k} < 3, NULL, if({_FLAT.format(k=k)}, 0, {_SKEW.format(k=k)}))" for k in _YEARS}, 4),
        ", ".join(f"count(r) OVER w{k} AS m{k}" for k in _YEARS),
    ),
    "t04_kurtosis": over_bars(
        shown({f"kurtosis_{k}d": f"if(count(*) OVER w{k} < {k} OR count(r) OVER w{k} < 4, NULL, if({_FLAT.format(k=k)}, 0, kurtosis_pop(r) OVER w{k}))" for k in _YEARS}, 4)
    ),
    "t05_realized_vol": over_bars(shown({f"realized_vol_{k}d": f"sqrt(252 * {whole('var_samp', 'l', k)})" for k in _YEARS})),
    "t06_parkinson_vol": over_bars(shown({f"parkinson_vol_{k}d": f"sqrt(252 * {whole('avg', 'x', k)})" for k in _YEARS}), "pow(ln(high / low), 2) / (4 * ln(2)) AS x"),
    "t07_garman_klass_vol": over_bars(
        shown({f"garman_klass_vol_{k}d": _annual("x", k) for k in _YEARS}, 5), "pow(ln(high / low), 2) / 2 - (ln(4) - 1) * pow(ln(close / open), 2) AS x"
    ),
    "t08_rogers_satchell_vol": over_bars(
        shown({f"rogers_satchell_vol_{k}d": f"sqrt(252 * greatest({whole('avg', 'x', k)}, 0 * {whole('avg', 'x', k)}))" for k in _YEARS}, 5),
        "ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS x",
    ),
    "t09_bipower_var": over_bars(shown({f"bipower_var_{k}d": f"126 * pi() * {whole('avg', 'x', k - 1)}" for k in _YEARS}), "abs(l * lag(l) OVER o) AS x"),
    "t10_reversal": over_bars(
        shown({f"reversal_{k}d": f"lag(x{k}) OVER o" for k in (5, 10, 21)}), ", ".join(f"{whole('sum', 'r', k)} AS x{k}" for k in (5, 10, 21))
    ),
    "t11_momentum_5_21": over_bars(shown({"momentum_5_21": f"{whole('sum', 'r', 21)} - {whole('sum', 'r', 5)}"})),
    "t12_price_levels": over_bars(
        shown({"pct_from_52w_high": "close / hi - 1", "pct_from_52w_low": "close / lo - 1", "price_position_52w": "(close - lo) / nullif(hi - lo, 0)"}),
        f"{whole('max', 'close', 252)} AS hi, {whole('min', 'close', 252)} AS lo",
    ),
    "t13_atr": over_bars(shown({f"atr_{k}": f"{whole('sum', 'tr', k)} / {k} / close" for k in (14, 63)}), _TRUE_RANGE),
    "t14_relative_volume": over_bars(shown({f"volume_rel_{k}": f"{k} * volume / nullif({whole('sum', 'volume', k)}, 0)" for k in (21, 63)})),
    "t15_pv_trend": over_bars(shown({"pv_trend_21": f"{whole('sum', 'x', 21)} / nullif({whole('sum', 'volume', 21)}, 0)"}, 8), "r * volume AS x"),
    "t16_vwap_deviation": over_bars(shown({"vwap_deviation": f"close * {whole('sum', 'volume', 21)} / nullif({whole('sum', 'x', 21)}, 0) - 1"}), "close * volume AS x"),
    "t17_momentum": over_bars(
        shown({n: f"lag(close, 21) OVER o / lag(close, {k}) OVER o - 1" for n, k in (("momentum_63d", 63), ("momentum_126d", 126), ("momentum_252d", 252), ("momentum_12_1", 252), ("momentum_6_1", 126))})
    ),
    "t18_trend_consistency": over_bars(shown({f"trend_consistency_{k}d": f"{whole('sum', 'x', k)} / {k}e0 - 0.5" for k in (21, 63)}), "coalesce((r > 0)::INT, 0) AS x"),
    "t19_moving_averages": over_bars(
        ", ".join(f"coalesce((round(close - a{k}, 7) > 0)::INT, 0) AS above_ma_{k}" for k in (21, 50, 200)) + ", coalesce((round(a21 - a63, 7) > 0)::INT, 0) AS ma_21_63_cross, "
        + shown({f"dist_from_ma_{k}": f"(close - a{k}) / a{k}" for k in (21, 50, 200)}), ", ".join(f"{whole('avg', 'close', k)} AS a{k}" for k in (21, 50, 63, 200)),
    ),
}
TECHNICAL["t20_all"] = "SELECT * FROM " + " JOIN ".join(f"({q})" + (" USING (ticker, date)" if i else "") for i, (n, q) in enumerate(TECHNICAL.items()) if n < "t17")


_K = (21, 63)
MICRO = {
    "m01_amihud": over_bars(
        ", ".join(f"round({whole('avg', 'i', k)}, 13) + 0.0 AS amihud_{k}d, round((i - {whole('avg', 'i', k)}) / {whole('stddev_samp', 'i', k)}, 5) + 0.0 AS amihud_zscore_{k}d" for k in _K),
        "abs(r) / nullif(close * volume, 0) AS i",
    ),
    "m02_kyle_lambda": over_bars(
        ", ".join(f"round(CASE WHEN k >= {k} AND count(v) OVER w{k} >= 3 THEN covar_pop(v, r) OVER w{k} / nullif(var_pop(v) OVER w{k}, 0) END, 10) + 0.0 AS kyle_lambda_{k}d" for k in _K),
        "row_number() OVER o AS k, CASE WHEN r IS NOT NULL THEN volume * sign(r) END AS v",
    ),
    "m07_corwin_schultz": over_bars(
        "round(CASE WHEN a IS NOT NULL THEN least(0.1, 2 * (exp(a) - 1) / (1 + exp(a))) END, 6) + 0.0 AS cs_spread",
        "(pow(ln(high / low), 2) + lag(pow(ln(high / low), 2)) OVER o) / 2 AS beta, pow(ln(greatest(high, lag(high) OVER o) / least(low, lag(low) OVER o)), 2) * CASE WHEN lag(high) OVER o IS NULL THEN NULL ELSE 1 END AS gamma",
        "(sqrt(2 * beta) - sqrt(beta)) / (3 - sqrt(8)) - sqrt(gamma / (3 - sqrt(8))) AS a0",
        "CASE WHEN a0 > 0 THEN a0 WHEN a0 <= 0 THEN 0 END AS a",
    ),
    "m10_up_down_volume": over_bars(
        ", ".join(f"round((2 * u{k} - a{k}) / (a{k} + 1e-10), 7) + 0.0 AS up_down_volume_{k}d" for k in _K),
        "CASE WHEN r > 0 THEN volume ELSE 0 END AS u",
        ", ".join(f"{whole('sum', 'u', k)} AS u{k}, {whole('sum', 'volume', k)} AS a{k}" for k in _K),
    ),
    "m11_liquidity_vol": over_bars(
        ", ".join(f"round({whole('stddev_samp', 'volume', k)} / {whole('avg', 'volume', k)}, 5) + 0.0 AS volume_vol_{k}d, round({whole('stddev_samp', 'i', k)}, 13) + 0.0 AS illiq_vol_{k}d" for k in _K),
        "abs(r) / nullif(close * volume, 0) AS i",
    ),
}
_SIGN = "if(high = low, 0, (close - low) / (high - low) - 0.5) AS ri, (2 * (close - low) / (high - low + 1e-10) - 1) AS q"
MICRO |= {
    "m03_m05_order_flow": over_bars(
        shown({"range_imbalance": "ri", "volume_imbalance": "vi"} | {f"cum_imbalance_{k}d": whole("sum", "vi", k) for k in (5, 21)} | {f"imbalance_trend_{k}d": whole("avg", "vi", k) for k in (5, 21)}, 5),
        _SIGN, "if(volume = 0, NULL, q) AS vi",
    ),
    "m06_roll_spread": over_bars(
        shown({"roll_spread": f"if(n = 21, sqrt(4 * greatest(0, -(regr_sxy(a, p) OVER w21) / 20)), NULL)"}, 5), "lag(r) OVER o AS p", "if(p IS NULL, NULL, r) AS a", "count(a) OVER w21 AS n"
    ),
    "m08_hl_spread": over_bars(shown({"hl_spread": "(high - low) / close"}, 8)),
    "m09_volume_hhi": over_bars(
        shown({f"volume_hhi_{k}d": whole("sum", f"x{k}", k) for k in _K}), ", ".join(f"pow(volume / nullif({whole('sum', 'volume', k)}, 0), 2) AS x{k}" for k in _K)
    ),
    "m12_volume_autocorr": over_bars(
        shown({f"volume_autocorr_{k}d": f"if(n{k} < {k} OR s{k} = 0 OR p{k} = 0, NULL, c{k} / sqrt(s{k} * p{k}))" for k in _K}, 5), "lag(volume) OVER o AS p",
        ", ".join(f"count(volume) OVER w{k} AS n{k}, regr_sxy(volume, p) OVER w{k - 1} AS c{k}, regr_syy(volume, p) OVER w{k - 1} AS s{k}, regr_sxx(volume, p) OVER w{k - 1} AS p{k}" for k in _K),
    ),
    "m13_flow_pressure": over_bars(shown({"quote_pressure": "q", "ofi": "q * volume"}, 5), _SIGN),
    "m14_vwap_distance": over_bars(
        shown({"vwap_distance": "(close - v) / (v + 1e-10)"}), "(high + low + close) / 3 * volume AS x", f"{whole('sum', 'x', 20)} / nullif({whole('sum', 'volume', 20)}, 0) AS v"
    ),
}
INFORMED = {
    "v04_csi": over_bars(
        ", ".join(f"round(g{k} / 6, 6) + 0.0 AS skew_adj_{k}, round((q{k} - 3) / 24, 6) + 0.0 AS kurt_adj_{k}, round(s{k} * (1 + g{k} / 6 + (q{k} - 3) / 24), 6) + 0.0 AS csi_{k}d, round(1 + g{k} / 6 + (q{k} - 3) / 24, 6) + 0.0 AS csi_ratio_{k}" for k in _K),
        ", ".join(_moments(k) for k in _K),
    ),
    "v05_vol_of_vol": over_bars(
        ", ".join(f"round({whole('stddev_samp', f's{k}', k)} / {whole('avg', f's{k}', k)}, 6) + 0.0 AS vol_of_vol_{k}d" for k in _K),
        ", ".join(_moments(k) for k in _K),
    ),
    "v06_tails": over_bars(
        ", ".join(f"round(-g{k}, 5) + 0.0 AS skew_premium_{k}d, round(q{k} - 3, 5) + 0.0 AS tail_risk_{k}d" for k in _K), ", ".join(_moments(k) for k in _K)
    ),
    "v08_term_structure": over_bars(
        "round(a - b, 6) + 0.0 AS vol_term_slope, round(b / c - 1, 6) + 0.0 AS vol_mean_reversion",
        ", ".join(f"{whole('stddev_samp', 'l', k)} * sqrt(252) AS {n}" for n, k in (("a", 5), ("b", 21), ("c", 252))),
    ),
}
for _name, _least in (("v07_vol_asymmetry", None), ("v07_vol_asymmetry_min5", 5)):
    _sd = lambda x, k, least=_least: f"CASE WHEN count({x}) OVER w{k} >= {least or k} THEN stddev_samp({x}) OVER w{k} END"
    INFORMED[_name] = over_bars(
        ", ".join(f"round(({_sd('u', k)} - {_sd('d', k)}) / {whole('stddev_samp', 'l', k)}, 6) + 0.0 AS vol_asymmetry_{k}d" for k in _K),
        "if(l > 0, l, NULL) AS u, if(l < 0, l, NULL) AS d",
    )

INDICATORS = {
    "i09_notebook_vols": over_bars(
        f"round({whole('stddev_samp', 'r', 20)} * sqrt(252), 6) + 0.0 AS realized_vol, round({whole('avg', 'h', 20)} * sqrt(252), 6) + 0.0 AS parkinson_vol",
        "sqrt(1 / (4 * ln(2)) * pow(ln(high / low), 2)) AS h",
    ),
}


def ic(x: str = "signal", y: str = "fwd", by: str = "date", src: str = "s", least: int = 10, row: str = "ticker") -> str:
    """Spearman's correlation a group, from ranks by counting."""
    keys = " AND ".join(f"a.{c} = b.{c}" for c in by.split(", "))
    cols = ", ".join(f"a.{c}" for c in by.split(", "))
    known = f"(SELECT * FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    half = lambda v: f"count(*) FILTER (b.{v} < a.{v}) + count(*) FILTER (b.{v} = a.{v}) / 2e0"
    return f"""SELECT {by}, CASE WHEN count(*) >= {least} AND max(u) > min(u) AND max(v) > min(v) THEN corr(u, v) END AS ic
FROM (SELECT {cols}, a.{row}, {half(x)} AS u, {half(y)} AS v FROM {known} a JOIN {known} b ON {keys} GROUP BY ALL) z GROUP BY {by}"""


def book(scored: str, by: str = "", own: str = "s") -> str:
    """CTEs from signals to daily costs on the dense grid."""
    k = f"{by}date"
    using = f"({k})"
    on = " AND ".join(f"a.{c} = b.{c}" for c in k.split(", "))
    return f"""
pct AS (SELECT a.*, (count(*) FILTER (b.signal < a.signal) + (count(*) FILTER (b.signal = a.signal) + 1) / 2e0) / count(*) AS pct, count(*) AS names
  FROM {own} a JOIN {own} b ON {on} WHERE a.signal IS NOT NULL AND b.signal IS NOT NULL GROUP BY ALL),
legs AS (SELECT *, CASE WHEN pct >= 0.9e0 THEN 1 WHEN pct <= 0.1e0 THEN -1 ELSE 0 END AS leg FROM pct WHERE names >= 10),
sizes AS (SELECT {k}, leg, count(*) AS size FROM legs GROUP BY {k}, leg),
w1 AS (SELECT legs.*, CASE WHEN leg = 0 THEN 0e0 ELSE leg / size::DOUBLE END AS w FROM legs JOIN sizes USING ({k}, leg)),
w2 AS (SELECT * REPLACE (CASE WHEN adv > 0 AND abs(w) * 10000000e0 > adv * 0.05e0 THEN w * (adv * 0.05e0 / (abs(w) * 10000000e0)) ELSE w END AS w) FROM w1),
tilt AS (SELECT {k}, sector, sum(w) AS e, count(*) AS m FROM w2 GROUP BY {k}, sector),
w3 AS (SELECT w2.* REPLACE (CASE WHEN abs(e) > 0.01e0 THEN w - e / m ELSE w END AS w) FROM w2 JOIN tilt USING ({k}, sector)),
gross_w AS (SELECT {k}, sum(w) FILTER (w > 0) AS lo, -sum(w) FILTER (w < 0) AS sh FROM w3 GROUP BY {k}),
w4 AS (SELECT w3.* REPLACE (CASE WHEN w > 0 THEN w / lo WHEN w < 0 THEN w / sh ELSE w END AS w) FROM w3 JOIN gross_w USING {using}),
grid AS (SELECT {by}date, ticker, w4.w, x.adv, x.ret FROM (SELECT DISTINCT {by}date FROM {own}) d CROSS JOIN (SELECT DISTINCT ticker FROM {own}) t
  LEFT JOIN w4 USING ({by}date, ticker) LEFT JOIN {own} x USING ({by}date, ticker)),
step AS (SELECT *, lag(w) OVER q AS h, coalesce(w, 0) - lag(coalesce(w, 0)) OVER q AS full_move FROM grid WINDOW q AS (PARTITION BY {by}ticker ORDER BY date)),
trade AS (SELECT *, abs(w - h) AS mv, abs(w - h) * 10000000e0 AS usd FROM step),
daily AS (SELECT {by}date, coalesce(sum(h * ret), 0) AS gross, coalesce(sum(mv), 0) / 2 AS traded, coalesce(sum(mv), 0) / 2 * 7.5e0 / 10000 AS cost,
  CASE WHEN count(*) FILTER (mv IS NOT NULL AND adv IS NULL) = 0
    THEN coalesce(sum(usd * (0.1e0 * sqrt(usd / 1000000e0) * sqrt(usd / (if(adv > 0, adv, 0) + 1e-10))) / 10000), 0) / 10000000e0 END AS impact,
  coalesce(sum(abs(full_move)), 0) / 2 AS turnover FROM trade GROUP BY {by}date)"""


def _figures(by: str = "", own: str = "s") -> str:
    """CTE `fig`: the result row of each run, after book()."""
    part = f"PARTITION BY {by.rstrip(', ')}" if by else ""
    group, first = (f"GROUP BY {by.rstrip(', ')}", by) if by else ("", "")
    sharpe = lambda c: f"CASE WHEN count({c}) >= 10 AND max({c}) > min({c}) THEN avg({c}) / stddev_samp({c}) * sqrt(252) END"
    join = (lambda a, b: f"{a} JOIN {b} USING ({by.rstrip(', ')})") if by else (lambda a, b: f"{a}, {b}")
    return f"""
net AS (SELECT *, gross - (cost + impact) AS net FROM daily),
path AS (SELECT {by}date, net, product(1 + net) OVER q AS cum FROM net WHERE net IS NOT NULL WINDOW q AS ({part} ORDER BY date)),
fall AS (SELECT *, cum / max(cum) OVER ({part} ORDER BY date) - 1 AS dd FROM path),
f1 AS (SELECT {first}count(*) AS days, {sharpe('gross')} AS gross_sharpe, sum(cost + impact) AS total_costs, avg(cost + impact) AS avg_daily_cost, avg(turnover) AS mean_turnover FROM net {group}),
f2 AS (SELECT {first}{sharpe('net')} AS net_sharpe, min(dd) AS max_drawdown, product(1 + net) - 1 AS total_return, pow(product(1 + net), 252e0 / count(*)) - 1 AS annualized_return,
  stddev_samp(net) * sqrt(252) AS volatility FROM fall {group}),
f3 AS (SELECT {first}avg(ic) AS mean_ic, avg(ic) / stddev_samp(ic) * sqrt(252) AS icir FROM ({ic('signal', 'ret', f'{by}date', own)}) y {group}),
fig AS (SELECT *, annualized_return / abs(max_drawdown) AS calmar_ratio FROM {join(join('f1', 'f2'), 'f3')})"""


_DIGITS = {"gross_sharpe": 4, "net_sharpe": 4, "max_drawdown": 6, "mean_turnover": 7, "total_return": 6, "annualized_return": 6, "volatility": 7, "mean_ic": 7, "icir": 4, "total_costs": 8, "avg_daily_cost": 11, "calmar_ratio": 5}
_SHOWN = ", ".join(f"round({c}, {n}) + 0.0 AS {c}" for c, n in _DIGITS.items())


def backtests(scored: str, years: str, trades: str) -> dict[str, str]:
    """scored, years and trades: the fixtures as queries."""
    base = f"WITH s AS ({scored}),{book(scored)}"
    every = "FROM s LEFT JOIN {w} USING (ticker, date)"
    weight = lambda w, n: f"{base} SELECT ticker, date, round({w}.w, {n}) + 0.0 AS weight " + every.format(w=w)
    split = f"WITH s AS ({scored}), own AS (SELECT y.split_id, s.* FROM s JOIN ({years}) y ON s.date BETWEEN y.lo AND y.hi),{book(scored, 'split_id, ', 'own')},{_figures('split_id, ', 'own')}"
    gate = {"ic_ok": "mean_ic > 0.055", "icir_ok": "icir > 0.9", "sharpe_ok": "net_sharpe > 1.8", "drawdown_ok": "max_drawdown > -0.22", "turnover_ok": "mean_turnover < 0.18"}
    impact = "CASE WHEN adv > 0 THEN v * (0.1e0 * sqrt(v / 1000000e0) * sqrt(v / adv)) / 10000 ELSE 0 END"
    t = f"WITH t AS (SELECT *, close * volume AS v FROM ({trades}) t0), i AS (SELECT *, {impact} AS imp FROM t)"
    return {
        "b02_target_weights": weight("w1", 8), "b03_capped_weights": weight("w2", 11), "b04_neutral_weights": weight("w3", 11),
        "b05_final_weights": f"{base} SELECT ticker, date, s.sector, round(w4.w, 8) + 0.0 AS weight " + every.format(w="w4"),
        "b06_gross_returns": f"{base} SELECT date, round(gross, 7) + 0.0 AS gross FROM daily",
        "b07_trading_costs": f"{base} SELECT date, round(traded, 7) AS traded, round(cost, 10) AS cost FROM daily",
        "b08_impact_costs": f"{base} SELECT date, round(impact, 10) AS impact FROM daily",
        "b09_result": f"{base},{_figures()} SELECT days, {_SHOWN} FROM fig",
        "b09_positions": f"{base} SELECT ticker, date, round(w * 10000000e0, 3) + 0.0 AS position, round(h * ret * 10000000e0, 3) + 0.0 AS pnl FROM trade WHERE w IS NOT NULL",
        "b10_walk_forward": f"""{split} SELECT split_id, days, {_SHOWN}, round(avg(net_sharpe) OVER (), 4) + 0.0 AS mean_net_sharpe, round(stddev_pop(net_sharpe) OVER (), 4) + 0.0 AS std_net_sharpe,
  round(avg(mean_ic) OVER (), 7) + 0.0 AS mean_ic_of_splits, round(avg(mean_turnover) OVER (), 7) + 0.0 AS mean_turnover_of_splits, round(avg(max_drawdown) OVER (), 6) + 0.0 AS mean_drawdown FROM fig""",
        "b11_transaction_costs": f"{t} SELECT ticker, date, round(v * 7.5e0 / 10000, 9) AS commission, round(v * 2e0 / 10000, 9) AS spread, round(imp, 9) AS impact, round(v * 9.5e0 / 10000 + imp, 8) AS total FROM i",
        "b12_market_impact": f"{t} SELECT ticker, date, round(imp * (1 - 0.2e0), 9) AS temporary, round(imp * 0.2e0, 9) AS permanent FROM i",
        "k17_acceptance_gate": f"{base},{_figures()} SELECT {', '.join(f'{e} AS {c}' for c, e in gate.items())}, {' AND '.join(gate.values())} AS accepted FROM fig",
    }


def metrics(scored: str, daily: str, weights: str) -> dict[str, str]:
    s = f"WITH s AS ({scored})"
    sharpe = lambda c: f"avg({c}) / stddev_samp({c}) * sqrt(252)"
    turn = f"""wt AS ({weights}), wg AS (SELECT date, ticker, coalesce(weight, 0) AS w FROM (SELECT DISTINCT date FROM wt) d CROSS JOIN (SELECT DISTINCT ticker FROM wt) t LEFT JOIN wt USING (date, ticker)),
wm AS (SELECT date, abs(w - lag(w) OVER (PARTITION BY ticker ORDER BY date)) AS m FROM wg), turned AS (SELECT date, coalesce(sum(m), 0) / 2 AS turnover FROM wm GROUP BY date)"""
    #: Density of Student's t integrated from 0 to |t| by Simpson's rule.
    density = "exp(lgamma((df + 1) / 2e0) - lgamma(df / 2e0)) / sqrt(df * pi()) * pow(1 + x * x / df, -(df + 1) / 2e0)"
    return {
        "k04_sharpe": f"SELECT round({sharpe('ret')}, 5) AS sharpe FROM ({daily})",
        "k05_max_drawdown": f"WITH c AS (SELECT date, product(1 + ret) OVER (ORDER BY date) AS c FROM ({daily})), d AS (SELECT c / max(c) OVER (ORDER BY date) - 1 AS d FROM c) SELECT round(min(d), 7) + 0.0 AS max_drawdown FROM d",
        "k06_turnover": f"WITH {turn} SELECT date, round(turnover, 10) + 0.0 AS turnover FROM turned",
        "k07_summary": f"""{s}, d AS ({daily}), i AS ({ic()}), {turn}, n AS (SELECT ret - coalesce(turnover, 0) * 7.5e0 / 10000 AS net FROM d LEFT JOIN turned USING (date)),
c AS (SELECT date, ret, product(1 + ret) OVER (ORDER BY date) AS c FROM d), f AS (SELECT *, c / max(c) OVER (ORDER BY date) - 1 AS dd FROM c),
a AS (SELECT avg(ic) AS m, stddev_samp(ic) AS sd, count(ic) AS k, avg((round(ic, 12) > 0)::INT) FILTER (ic IS NOT NULL) * count(ic) / count(*) AS hit FROM i), tt AS (SELECT *, m / sd * sqrt(k) AS t FROM a),
px AS (SELECT k - 1 AS df, abs(t) / 2000 AS h, unnest(range(2001)) AS j, abs(t) / 2000 * unnest(range(2001)) AS x FROM tt),
p AS (SELECT 1 - 2 * sum({density} * CASE WHEN j IN (0, 2000) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END) * max(h) / 3 AS p FROM px),
b AS (SELECT count(*) AS days, {sharpe('ret')} AS sh, product(1 + ret) AS g, min(dd) AS dd, stddev_samp(ret) * sqrt(252) AS vol, avg((ret > 0)::INT) AS win FROM f),
u AS (SELECT avg(turnover) AS u FROM turned), ns AS (SELECT {sharpe('net')} AS ns FROM n)
SELECT round(m, 7) AS mean_ic, round(m / sd * sqrt(252), 5) AS icir, round(hit, 6) AS ic_hit_rate, k AS ic_days, round(t, 7) AS ic_t_stat, round(sh, 5) AS gross_sharpe, round(ns, 5) AS net_sharpe,
  days AS n_days, round(u, 8) AS mean_turnover, round(u * 7.5e0 / 10000, 12) AS turnover_cost, round(g - 1, 5) AS total_return, round(pow(g, 252e0 / days) - 1, 6) AS annualized_return,
  round(dd, 6) AS max_drawdown, round(vol, 6) AS volatility, round((pow(g, 252e0 / days) - 1) / abs(dd), 5) AS calmar, round(win, 6) AS win_rate, round(p, 6) AS ic_pvalue FROM tt, p, b, u, ns""",
        "k09_quantile_returns": f"""{s}, k AS (SELECT * FROM s WHERE signal IS NOT NULL AND fwd IS NOT NULL),
q AS (SELECT date, {', '.join(f'quantile_cont(signal, {i / 10}) AS e{i}' for i in range(11))} FROM k GROUP BY date HAVING count(*) >= 10),
l AS (SELECT date, list_sort(list_distinct([{', '.join(f'e{i}' for i in range(11))}])) AS edges FROM q),
z AS (SELECT k.date, fwd, greatest(1, len(list_filter(edges, lambda x: x < signal))) AS quantile FROM k JOIN l USING (date)),
d AS (SELECT date, quantile, avg(fwd) AS r, count(*) AS c FROM z GROUP BY ALL), g AS (SELECT count(DISTINCT date) AS dates FROM d),
m AS (SELECT quantile, avg(r) AS r, count(*) AS days, sum(c) AS c FROM d GROUP BY quantile)
SELECT quantile, round(r, 8) + 0.0 AS mean_return, days, round(c / dates::DOUBLE, 6) AS n_stocks,
  round((SELECT arg_max(r, quantile) - arg_min(r, quantile) FROM m), 8) + 0.0 AS spread FROM m, g""",
    }


def cross_sections(scored: str, weights: str) -> dict[str, str]:
    """Quantiles, ranks and buckets from sorted lists of a date's values; grids and exposures from joins on all pairs."""
    s = f"WITH s AS ({scored})"
    lists = f"{s}, d AS (SELECT date, list_sort(list(signal) FILTER (signal IS NOT NULL)) AS v FROM s GROUP BY date)"
    # A quantile between two neighbours in the sorted list.
    q = lambda v, p: f"({v}[floor((len({v}) - 1) * {p})::INT + 1] + ((len({v}) - 1) * {p} - floor((len({v}) - 1) * {p})) * ({v}[least(len({v}), floor((len({v}) - 1) * {p})::INT + 2)] - {v}[floor((len({v}) - 1) * {p})::INT + 1]))"
    rank = "(len(list_filter(v, lambda x: x < signal)) + (len(list_filter(v, lambda x: x = signal)) + 1) / 2e0) / len(v)"

    def z(flat: str) -> str:
        one = lambda x: f"""n_{x} AS (SELECT ticker, date, w, if(count(w) OVER g < 2 OR max(w) OVER g = min(w) OVER g, {flat}, (w - avg(w) OVER g) / stddev_samp(w) OVER g) AS z FROM (
  SELECT ticker, s.date, least(greatest(s.{x}, {q('v', 0.05)}), {q('v', 0.95)}) AS w FROM s JOIN (SELECT date, list_sort(list({x}) FILTER ({x} IS NOT NULL)) AS v FROM s GROUP BY date) l ON s.date = l.date WHERE s.{x} IS NOT NULL) u WINDOW g AS (PARTITION BY date))"""  # noqa: E731
        cut = lambda x: f"if({x}.z IS NULL, NULL, round(least(3, greatest(-3, {x}.z)), 5) + 0.0)"
        return f"""{s}, {one('signal')}, {one('volume')} SELECT s.ticker, s.date, {cut('a')} AS signal, {cut('b')} AS volume
FROM s LEFT JOIN n_signal a USING (ticker, date) LEFT JOIN n_volume b USING (ticker, date)"""

    edges = ", ".join(q("v", i / 10) for i in range(10))
    w = f"WITH w AS ({weights})"
    return {
        "x01_normalise": z("0"),
        "x02_normalise_wide": z("w - avg(w) OVER g"),
        "x03_percent_rank": f"{lists} SELECT ticker, s.date, round(if(signal IS NULL, NULL, {rank}), 8) AS pct_rank FROM s JOIN d ON s.date = d.date",
        "x04_deciles": f"""{lists}, r AS (SELECT ticker, s.date, round({rank}, 9) AS r, len(v) AS n, signal FROM s JOIN d ON s.date = d.date)
SELECT ticker, date, if(signal IS NULL OR n < 10, NULL, (r >= 0.9)::INT - (r <= 0.1)::INT) AS side FROM r""",
        "x05_quantile_buckets": f"""{lists}, e AS (SELECT date, v, list_distinct([{edges}]) AS e FROM d)
SELECT ticker, s.date, if(signal IS NULL OR len(v) < 10, NULL, greatest(0, len(list_filter(e, lambda x: x < signal)) - 1)) AS bucket FROM s JOIN e ON s.date = e.date""",
        "x06_date_slice": f"{s} SELECT ticker, ifnull(signal, 0) AS signal, ifnull(volume, 0) AS volume FROM s WHERE date = DATE '1996-05-06'",
        "x07_cube": f"""WITH b AS (SELECT * FROM ({BARS_SQL}) WHERE date >= DATE '1996-01-01' AND date < DATE '1996-07-01')
SELECT d.date, t.ticker, b.close, b.volume FROM (SELECT DISTINCT date FROM b) d, (SELECT DISTINCT ticker FROM b) t LEFT JOIN b ON b.date = d.date AND b.ticker = t.ticker""",
        "x10_sector_exposure": f"""{w} SELECT d.date, k.sector, round(ifnull((SELECT sum(weight) FROM w WHERE w.date = d.date AND w.sector = k.sector), 0), 8) + 0.0 AS exposure
FROM (SELECT DISTINCT date FROM w) d, (SELECT DISTINCT sector FROM w) k""",
        "x11_factor_exposure": f"""{w}, s AS ({scored}) SELECT date, round(list_sum(list(weight * signal)), 9) + 0.0 AS signal, round(list_sum(list(weight * volume)), 9) + 0.0 AS volume
FROM w JOIN (SELECT ticker, date, signal, volume FROM s) p USING (ticker, date) GROUP BY date""",
        "x12_concentration": f"{w} SELECT date, round(list_sum(list_transform(list(weight), lambda x: x * x)), 8) AS hhi FROM w GROUP BY date",
    }


def barrier_events(batch: bool = False, h: int = 10) -> str:
    """Each row met with the h rows after it, one by one; the first of them that leaves the band decides."""
    where = f"i < n - {h + 1}" if batch else "i >= 20"
    bands = "" if batch else ", round(close * (1 + b), 5) AS upper_barrier, round(close * (1 - b), 5) AS lower_barrier"
    return f"""WITH c AS ({over_bars("close, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n, " + whole('stddev_samp', 'r', 20) + " AS vol")}),
s AS (SELECT *, round(1.5e0 * vol, 9) AS b FROM c WHERE vol > 0 AND {where}),
m AS (SELECT s.ticker, s.i, x.i - s.i AS k, x.date AS d, round(x.close / s.close - 1, 9) AS ret, abs(round(x.close / s.close - 1, 9)) >= s.b AS out FROM s JOIN c x ON x.ticker = s.ticker AND x.i > s.i AND x.i <= s.i + {h}),
f AS (SELECT ticker, i, max(d) AS t1, coalesce(min(k) FILTER (out), max(k)) AS k, bool_or(out) AS out FROM m GROUP BY ticker, i)
SELECT s.ticker, s.date AS t0, ifnull(f.t1, s.date) AS t1, ifnull(m.d, s.date) AS first_touch_date, if(f.out, if(m.ret > 0, 1, -1), 0) AS barrier_side, ifnull(m.ret, 0) + 0.0 AS return_at_touch,
  ifnull(f.k, 0)::INT AS days_held, CASE WHEN f.out THEN if(m.ret > 0, 1, -1) WHEN m.ret >= 0.005 THEN 1 WHEN m.ret <= -0.005 THEN -1 ELSE 0 END AS label{bands}
FROM s LEFT JOIN f ON f.ticker = s.ticker AND f.i = s.i LEFT JOIN m ON m.ticker = s.ticker AND m.i = s.i AND m.k = f.k"""


def labels(scored: str, probs: str) -> dict[str, str]:
    """Events from the rows after each row; lives by joining days with the events alive on them."""
    e = f"WITH e AS ({barrier_events()}), q AS ({probs})"
    share = lambda test: f"count(*) FILTER ({test}) / count(*)::DOUBLE"
    return {
        "l01_daily_vol": over_bars(shown({"vol": whole("stddev_samp", "r", 20)}, 7)),
        "l02_l03_barrier_events": barrier_events(),
        "l04_l06_batch_events": barrier_events(batch=True),
        "l05_uniqueness_weights": f"""{e}, b AS (SELECT ticker, date FROM ({BARS_SQL})), c AS (SELECT b.ticker, b.date, count(*) AS c FROM b JOIN e ON e.ticker = b.ticker AND b.date BETWEEN e.t0 AND e.t1 GROUP BY ALL),
w AS (SELECT e.ticker, e.t0, 1 / avg(c) AS w FROM e JOIN c ON c.ticker = e.ticker AND c.date BETWEEN e.t0 AND e.t1 GROUP BY ALL)
SELECT w.ticker, t0, round(w / total, 9) AS weight FROM w JOIN (SELECT ticker, sum(w) AS total FROM w GROUP BY ticker) USING (ticker)""",
        "l07_stage_one": f"{e} SELECT ticker, t0, abs(barrier_side) AS label FROM e",
        "l08_stage_two": f"{e} SELECT e.ticker, t0, (barrier_side = 1)::INT AS label FROM e JOIN q ON q.ticker = e.ticker AND q.date = e.t0 WHERE p1 > 0.65 AND barrier_side IN (1, -1)",
        "l09_meta_labels": f"{e} SELECT e.ticker, t0, if(p1 > 0.65, nullif(barrier_side, 0), NULL) AS meta FROM e LEFT JOIN q ON q.ticker = e.ticker AND q.date = e.t0",
        "l10_training_set": f"{e}, s AS ({scored}) SELECT ticker, t0, label, signal, volume FROM e JOIN (SELECT ticker, date AS t0, signal, volume FROM s) x USING (ticker, t0)",
        "l11_bet_size": f"SELECT ticker, date, round(if(p1 >= 0.65, least(1, p1 * abs(2 * p2 - 1)), 0), 8) AS size FROM ({probs})",
        "l12_purged_split": f"{e} SELECT ticker, t0, 'test' AS part FROM e WHERE t0 >= DATE '1996-07-01' UNION ALL SELECT ticker, t0, 'train' FROM e WHERE t0 <= DATE '1996-06-28' AND NOT t1 >= DATE '1996-07-01'",
        "l13_quality_report": f"""{e}, a AS (SELECT ticker, count(*) AS n, {share('label = 1')} AS up, {share('label = -1')} AS down, {share('label = 0')} AS flat, {share('barrier_side = 1')} AS u,
  {share('barrier_side = -1')} AS l, {share('barrier_side = 0')} AS z, avg(days_held) AS days, avg(return_at_touch) AS m, stddev_samp(return_at_touch) AS sd FROM e GROUP BY ticker)
SELECT ticker, n, round(up, 6) AS up, round(down, 6) AS down, round(flat, 6) AS flat, round(u, 6) AS upper_touches, round(l, 6) AS lower_touches, round(z, 6) AS time_exits, round(days, 6) AS days,
  round(m, 7) + 0.0 AS mean_ret, round(sd, 7) AS sd_ret, len(list_filter([up, down, flat], lambda x: x > 0 AND x < 0.1)) > 0 AS rare_class, z > 0.5 AS slow FROM a""",
        "l14_look_ahead": f"{e} SELECT ticker, count(*) AS n_events, count(*) FILTER ((ticker, t0) IN (SELECT (ticker, date) FROM ({BARS_SQL}))) AS with_features, count(*) FILTER (t1 < t0) AS backwards FROM e GROUP BY ticker",
    }


def signal_metrics(scored: str, daily: str) -> dict[str, str]:
    """Correlations from ranks by counting pairs; products in place of sums of logarithms."""
    s, d = f"WITH s AS ({scored})", f"WITH d AS ({daily})"
    year = "sqrt(252e0)"
    ratio = f"CASE WHEN count(ic) >= 10 AND max(ic) > min(ic) THEN avg(ic) / stddev_samp(ic) * {year} END"
    decay = " UNION ALL ".join(f"SELECT {h} AS horizon, ic FROM ({ic(y=f'fwd_{h}')})" for h in (1, 5, 10, 21))
    order = lambda v: f"count(*) FILTER ((b.{v}, b.ticker) <= (a.{v}, a.ticker))"
    k = "(SELECT * FROM s WHERE signal IS NOT NULL AND fwd IS NOT NULL)"
    full = lambda c, e: f"if(count({c}) OVER w = 252, {e}, NULL)"
    w = "WINDOW w AS (ORDER BY date ROWS 251 PRECEDING)"
    return {
        "k01_ic": f"{s} SELECT ticker, round(ic, 6) + 0.0 AS ic FROM ({ic(by='ticker', row='date')})",
        "k01_ic_pearson": f"""{s} SELECT ticker, round(if(count(*) >= 10 AND max(signal) > min(signal) AND max(fwd) > min(fwd),
  (avg(signal * fwd) - avg(signal) * avg(fwd)) / sqrt((avg(signal * signal) - pow(avg(signal), 2)) * (avg(fwd * fwd) - pow(avg(fwd), 2))), NULL), 6) + 0.0 AS ic FROM {k} GROUP BY ticker""",
        "k02_daily_ic": f"{s} SELECT date, round(ic, 6) + 0.0 AS ic FROM ({ic()})",
        "k03_icir": f"{s} SELECT round(avg(ic), 7) AS mean_ic, round({ratio}, 5) AS icir, count(ic) AS n FROM ({ic()})",
        "k08_ic_decay": f"{s} SELECT horizon, round(avg(ic), 7) AS mean_ic, round(stddev_samp(ic), 7) AS std_ic, round({ratio}, 5) AS icir FROM ({decay}) GROUP BY horizon",
        "k10_sector_ic": f"""{s} SELECT sector, round(avg(ic), 7) + 0.0 AS mean_ic, round({ratio}, 5) + 0.0 AS icir, count(ic) AS days, any_value(n) AS n_stocks
FROM ({ic(by='date, sector')}) JOIN (SELECT sector, len(list_distinct(list(ticker))) AS n FROM s GROUP BY sector) USING (sector) GROUP BY sector""",
        "k11_rolling_metrics": f"""{d}, c AS (SELECT *, product(1 + ret) OVER (ORDER BY date) AS c FROM d), x AS (SELECT *, if(count(c) OVER w = 252, c / max(c) OVER w - 1, NULL) AS dd FROM c {w})
SELECT date, round({full('ret', 'sum(ret) OVER w')}, 7) + 0.0 AS mean_return, round({full('ret', f'sqrt(252 * var_samp(ret) OVER w)')}, 7) AS volatility,
  round({full('ret', f'sum(ret) OVER w / sqrt(252 * var_samp(ret) OVER w)')}, 5) + 0.0 AS sharpe, round({full('dd', 'min(dd) OVER w')}, 7) + 0.0 AS max_drawdown FROM x {w}""",
        "k12_sharpe_variants": f"""{d} SELECT round(avg(ret) / (sqrt(var_pop(ret)) + 1e-10) * {year}, 5) AS sharpe_eps, round(avg(ret) / sqrt(var_pop(ret)) * {year}, 5) AS sharpe_pop,
  round(avg(ret) / sqrt(var_samp(ret)) * {year}, 5) AS sharpe_samp FROM d""",
        "k13_max_drawdown_from_one": f"""{d}, c AS (SELECT date, product(1 + ret) OVER (ORDER BY date) AS c FROM d UNION ALL SELECT DATE '1900-01-01', 1)
SELECT round(min(dd), 7) + 0.0 AS max_drawdown FROM (SELECT c / max(c) OVER (ORDER BY date) - 1 AS dd FROM c)""",
        "k14_ordinal_ic": f"""{s} SELECT date, round(if(count(*) < 2, 0, corr(u, v)), 6) + 0.0 AS ic
FROM (SELECT a.date, a.ticker, {order('signal')} AS u, {order('fwd')} AS v FROM {k} a JOIN {k} b ON a.date = b.date GROUP BY ALL) GROUP BY date""",
        "k15_strategy_return": f"""{s} SELECT date, round(list_sum(list(p)), 9) + 0.0 AS total, round(count(*) FILTER (p > 0) / count(*)::DOUBLE, 7) AS win_rate
FROM (SELECT date, CASE WHEN signal > 0 THEN fwd WHEN signal < 0 THEN -fwd ELSE 0 END AS p FROM {k}) GROUP BY date""",
        "k16_ic_monitor": f"""{s}, i AS (SELECT date, ic, row_number() OVER (ORDER BY date) AS n FROM ({ic()}) WHERE ic IS NOT NULL)
SELECT a.date, round(any_value(a.ic), 6) + 0.0 AS ic, count(*) FILTER (round(b.ic, 9) < 0.03) = 3 AS alert FROM i a JOIN i b ON b.n BETWEEN a.n - 2 AND a.n GROUP BY a.date""",
    }


def pooled(scored: str, groups: int = 6, purge: int = 63, embargo: int = 21) -> dict[str, str]:
    """Rank correlations over whole columns: ranks by counting what is smaller and what is equal."""
    s = f"WITH s AS ({scored}), k AS (SELECT date, signal, fwd, sign(signal) * fwd AS pnl FROM s WHERE signal IS NOT NULL AND fwd IS NOT NULL)"
    rank = lambda src, x, by="": f"(SELECT {by}{x} AS v, sum(count(*)) OVER ({f'PARTITION BY {by[:-2]} ' if by else ''}ORDER BY {x}) - (count(*) - 1) / 2e0 AS r FROM {src} GROUP BY {by}{x})"
    year = "sqrt(252e0)"
    return {
        "k01_ic_whole": f"""{s} SELECT count(*) AS n, round(corr(a.r, b.r), 7) + 0.0 AS ic FROM k JOIN {rank('k', 'signal')} a ON k.signal = a.v JOIN {rank('k', 'fwd')} b ON k.fwd = b.v""",
        "p07_evaluate": f"""{s}, d AS (SELECT date, least({groups - 1}, (row_number() OVER (ORDER BY date) - 1) // (count(*) OVER () // {groups})) AS g FROM (SELECT DISTINCT date FROM s)),
c AS (SELECT (row_number() OVER (ORDER BY a, b) - 1)::INT AS combo, a, b FROM range({groups}) x(a), range({groups}) y(b) WHERE a < b),
t AS (SELECT combo, k.* FROM k JOIN d USING (date) JOIN c ON g = a OR g = b),
r AS (SELECT t.combo, pnl, p.r AS a, q.r AS b, u.r AS c, w.r AS d FROM t
  JOIN {rank('t', 'signal', 'combo, ')} p ON t.combo = p.combo AND t.signal = p.v JOIN {rank('t', 'fwd', 'combo, ')} q ON t.combo = q.combo AND t.fwd = q.v
  JOIN {rank('t', 'signal')} u ON t.signal = u.v JOIN {rank('t', 'fwd')} w ON t.fwd = w.v),
o AS (SELECT corr(c, d) AS pic, avg(pnl) / (stddev_pop(pnl) + 1e-10) * {year} AS ps FROM r),
e AS (SELECT combo, count(*) AS n, corr(a, b) AS ic, avg(pnl) / (stddev_pop(pnl) + 1e-10) * {year} AS sh FROM r GROUP BY combo)
SELECT combo, n, round(ic, 7) + 0.0 AS ic, round(sh, 5) + 0.0 AS sharpe, round(pic, 7) + 0.0 AS pooled_ic, round(ps, 5) + 0.0 AS pooled_sharpe,
  round(avg(ic) OVER (), 7) + 0.0 AS mean_ic, round(stddev_pop(ic) OVER (), 7) + 0.0 AS std_ic, round(avg(sh) OVER (), 5) + 0.0 AS mean_sharpe FROM e, o""",
    }


def sequences(scored: str) -> dict[str, str]:
    """Sequences as rows, from numbered dates and rows."""
    return {
        "x08_last_sequence": f"""WITH b AS ({BARS_SQL}), n AS (SELECT * FROM b WHERE date BETWEEN DATE '1996-05-06' - 20 AND DATE '1996-05-06'),
d AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS k FROM (SELECT DISTINCT date FROM n))
SELECT t.ticker, (10 - k)::INT AS step, round(coalesce(n.close, 0), 7) AS close, round(coalesce(n.volume, 0), 7) AS volume
FROM (SELECT DISTINCT ticker FROM n) t CROSS JOIN d LEFT JOIN n ON n.ticker = t.ticker AND n.date = d.date WHERE k <= 10 AND (SELECT count(*) FROM d) >= 10""",
        "x09_supervised": f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM ({scored}))
SELECT a.ticker, a.date, (b.i - a.i + 10)::INT AS step, round(b.close, 7) AS close, round(b.volume, 7) AS volume, round(b.signal, 7) AS signal, a.fwd AS y
FROM s a JOIN s b ON a.ticker = b.ticker AND b.i BETWEEN a.i - 10 AND a.i - 1 WHERE a.i > 10""",
    }


def ewm_deviation(span: int = 20) -> str:
    """Weighted moments as running sums scaled by powers of the decay."""
    keep = 1 - 2 / (span + 1)
    run = "OVER (PARTITION BY ticker ORDER BY i ROWS UNBOUNDED PRECEDING)"
    return f"""WITH r AS (SELECT ticker, date, row_number() OVER o AS i, close / lag(close) OVER o - 1 AS r FROM ({BARS_SQL}) WINDOW o AS (PARTITION BY ticker ORDER BY date)),
w AS (SELECT *, CASE WHEN r IS NOT NULL THEN power({keep!r}e0, -i) END AS w FROM r),
s AS (SELECT *, sum(w) {run} AS s, sum(w * w) {run} AS q, sum(w * r) {run} AS x, sum(w * r * r) {run} AS y, count(r) {run} AS k FROM w)
SELECT ticker, date, round(CASE WHEN k > 1 THEN sqrt(greatest(0, (y / s - power(x / s, 2)) * s * s / (s * s - q))) END, 7) AS vol FROM s"""


def cleaning(dirty: str) -> dict[str, str]:
    """dirty: the fixture as a query. Neighbours by as-of joins and by lists."""
    five = ("open", "high", "low", "close", "volume")
    d = f"d AS (SELECT * FROM ({dirty}) WHERE seq = 0)"
    parts = " ".join(
        f"ASOF LEFT JOIN (SELECT ticker, date, {c} AS v FROM d WHERE {c} IS NOT NULL) b_{c} ON d.ticker = b_{c}.ticker AND d.date >= b_{c}.date "
        f"ASOF LEFT JOIN (SELECT ticker, date, {c} AS v FROM d WHERE {c} IS NOT NULL) a_{c} ON d.ticker = a_{c}.ticker AND d.date <= a_{c}.date"
        for c in five
    )
    value = lambda c: f"CASE WHEN d.{c} IS NOT NULL THEN d.{c} WHEN b_{c}.v IS NULL THEN NULL WHEN a_{c}.v IS NULL THEN b_{c}.v ELSE b_{c}.v + (a_{c}.v - b_{c}.v) * (d.date - b_{c}.date) / (a_{c}.date - b_{c}.date) END"
    return {
        "c06_interpolate": f"WITH {d} SELECT d.ticker, d.date, {', '.join(f'round({value(c)}, 6) AS {c}' for c in five)} FROM d {parts}",
        "c07_align_to_calendar": f"""WITH b AS ({BARS_SQL}), g AS (SELECT ticker, day::DATE AS date FROM (SELECT DISTINCT ticker FROM b) t
  CROSS JOIN (SELECT unnest(generate_series((SELECT min(date) FROM b), (SELECT max(date) FROM b), INTERVAL 1 DAY)) AS day) x WHERE dayofweek(day) BETWEEN 1 AND 5)
SELECT g.ticker, g.date, {', '.join(f'b.{c}' for c in five)} FROM g ASOF LEFT JOIN (SELECT * FROM b WHERE dayofweek(date) BETWEEN 1 AND 5) b ON g.ticker = b.ticker AND g.date >= b.date""",
    }


def asof(compare: str) -> str:
    """The engine's own as-of join, and the tolerance after it."""
    near = "abs(date_diff('day', k.date, a.date)) <= 5"
    return f"""WITH b AS ({BARS_SQL}), a AS (SELECT ticker, date + 2 AS date FROM b WHERE day(date) % 2 = 1), k AS (SELECT ticker, date, close FROM b WHERE day(date) % 4 = 0)
SELECT a.ticker, a.date, CASE WHEN {near} THEN k.date END AS known, CASE WHEN {near} THEN round(k.close, 6) END AS close
FROM a ASOF LEFT JOIN k ON a.ticker = k.ticker AND a.date {compare} k.date"""


def walk_forward(first: int = 504, purge: int = 63, val: int = 252, test: int = 252, roll: int = 252) -> str:
    """Splits as positions in one list of the panel's dates."""
    at = lambda e: f"d[{e}]"
    return f"""WITH l AS (SELECT list_sort(list(DISTINCT date)) AS d FROM ({BARS_SQL})), s AS (SELECT d, k, {first} + k * {roll} AS t FROM l, range(100) x(k))
SELECT k::INT AS split_id, {at(1)} AS train_start, {at('t')} AS train_end, {at(f't + {purge}')} AS purge_end, {at(f't + {purge} + 1')} AS val_start, {at(f't + {purge} + 1 + {val}')} AS val_end,
  {at(f't + {purge} + 2 + {val}')} AS test_start, {at(f'least(t + {purge} + 2 + {val} + {test}, len(d))')} AS test_end FROM s WHERE t + {purge} + 2 + {val} <= len(d)"""


_FIVE = ("open", "high", "low", "close", "volume")


def splits(panel_splits: str) -> dict[str, str]:
    """Parts of the dates by their positions in one numbered list."""
    d = f"d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, (SELECT count(DISTINCT date) FROM ({BARS_SQL})) AS n FROM (SELECT DISTINCT date FROM ({BARS_SQL})))"
    spans = "r AS (" + " UNION ALL ".join(f"SELECT split_id, '{p}' AS part, {p}_start AS lo, {p}_end AS hi FROM p" for p in ("train", "val", "test")) + ")"
    rows = f"WITH p AS ({panel_splits}), {spans}, a AS (SELECT split_id, ticker, date, part FROM ({BARS_SQL}) b JOIN r ON b.date >= lo AND b.date <= hi)"
    combo = f"""{d}, g AS (SELECT date, i, least(5, i // (n // 6)) AS g FROM d), c AS (SELECT (row_number() OVER (ORDER BY a, b) - 1)::INT AS combo, a, b FROM range(6) x(a), range(6) y(b) WHERE a < b),
t AS (SELECT combo, date, i FROM c JOIN g ON g = a OR g = b), e AS (SELECT combo, min(i) - 63 AS lo, max(i) + 21 AS hi FROM t GROUP BY combo),
k AS (SELECT combo, date, 'test' AS part FROM t UNION ALL SELECT combo, date, 'train' FROM g, e WHERE NOT (i >= lo AND i <= hi)),
z AS (SELECT combo, count(*) FILTER (part = 'train') AS train_days, count(*) FILTER (part = 'test') AS test_days FROM k GROUP BY combo HAVING count(*) FILTER (part = 'train') >= 100)"""
    return {
        "p02_assign": f"{rows} SELECT * FROM a",
        "p03_summary": f"{rows} SELECT split_id, part, count(*) AS n_rows, len(list_distinct(list(ticker))) AS n_tickers, len(list_distinct(list(date))) AS n_days, min(date) AS first_day, max(date) AS last_day FROM a GROUP BY ALL",
        "p04_purged_kfold": f"""WITH {d}, f AS (SELECT date, i, n, k::INT AS fold, k * (n // 5) AS s, CASE WHEN k = 4 THEN n ELSE (k + 1) * (n // 5) END AS e FROM d, range(5) x(k))
SELECT fold, date, 'test' AS part FROM f WHERE i BETWEEN s AND e - 1 UNION ALL SELECT fold, date, 'train' FROM f WHERE i NOT BETWEEN s AND e - 1 AND (i < s - 63 OR i > least(n - 1, e + 21))""",
        "p05_temporal": f"WITH {d} SELECT date, 'train' AS part FROM d WHERE i < floor(n * 0.7) UNION ALL SELECT date, 'test' FROM d WHERE i >= floor(n * 0.7) AND i >= least(floor(n * 0.7) + 63, n - 1)",
        "p06_combinatorial": f"WITH {combo} SELECT * FROM z",
        "p06_roles": f"WITH {combo} SELECT combo, date, part FROM k SEMI JOIN z USING (combo)",
        "p07_holdout_80_20": f"WITH {d} SELECT date, if(i < floor(n * 0.8), 'train', 'test') AS part FROM d",
        "p07_holdout_70_15_15": f"WITH {d} SELECT date, if(i < floor(n * 0.7), 'train', if(i < floor(n * 0.7) + floor(n * 0.15), 'val', 'test')) AS part FROM d",
    }


def universes(changes: str, current: str, members: str, extra: str) -> dict[str, str]:
    """Membership a day from the last change before it; liquidity by the engine's as-of join."""
    days = lambda a, b: f"(SELECT unnest(generate_series(DATE '{a}', DATE '{b}', INTERVAL 1 DAY))::DATE AS date)"
    week = "dayname(date) NOT IN ('Saturday', 'Sunday')"
    m = f"WITH m AS (SELECT * FROM ({members}) WHERE in_universe)"
    return {
        "u01_reconstruct": f"""WITH c AS ({changes}), k AS (SELECT DISTINCT ticker FROM c UNION SELECT ticker FROM ({current})), g AS (SELECT ticker, date FROM k, {days('1995-01-02', '1998-12-31')} d WHERE {week}),
l AS (SELECT g.ticker, g.date, arg_max(action, (c.date, action)) FILTER (c.date < g.date) AS before, arg_min(action, (c.date, action)) AS first FROM g LEFT JOIN c ON c.ticker = g.ticker GROUP BY ALL)
SELECT date, ticker, true AS in_universe FROM l WHERE before = 'add' OR (before IS NULL AND (first = 'remove' OR first IS NULL))""",
        "u03_full_universe": f"""WITH m AS ({members}), x AS (SELECT ticker, date FROM ({extra}), {days('1995-01-02', '1995-12-29')} d WHERE {week})
SELECT date, ticker, bool_or(i) AS in_universe FROM (SELECT date, ticker, in_universe AS i FROM m UNION ALL SELECT date, ticker, true FROM x) GROUP BY ALL""",
        "u04_on_date": f"{m} SELECT ticker FROM m WHERE date = DATE '1996-05-06'",
        "u04_date_range": f"{m} SELECT date, ticker FROM m WHERE date >= DATE '1995-01-02' AND date < DATE '1999-01-01'",
        "u05_liquidity_filter": f"""{m}, b AS (SELECT ticker, date, avg(close) OVER w AS p, avg(close * volume) OVER w AS v, count(*) OVER w AS n FROM ({BARS_SQL}) WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 20 PRECEDING))
SELECT m.ticker, m.date, round(p, 5) AS price, round(v, 3) AS dollars FROM m ASOF JOIN b ON m.ticker = b.ticker AND m.date >= b.date WHERE n >= 5 AND p >= 5 AND v >= 30000""",
        "u06_latest": f"{m} SELECT ticker, date FROM m WHERE date = (SELECT max(date) FROM ({members}))",
        "u07_nearest_date": f"WITH b AS ({BARS_SQL}) SELECT ticker, date, round(close, 6) AS close FROM b WHERE date IN (SELECT date FROM b WHERE date < DATE '1996-05-06' ORDER BY date DESC LIMIT 1)",
        "u08_adv_snapshot": f"""WITH l AS (SELECT ticker, list(close * volume ORDER BY date DESC)[1:21] AS v FROM ({BARS_SQL}) GROUP BY ticker)
SELECT ticker, round(list_sum(v) / len(v), 4) AS adv FROM l WHERE len(v) >= 5""",
        "u09_period_tickers": f"{m} SELECT ticker FROM m WHERE date BETWEEN DATE '1995-01-02' AND DATE '1998-12-31' GROUP BY ticker",
    }


def cleaned(dirty: str) -> dict[str, str]:
    """Values carried on by the last known date; a move is set against the last two known closes."""
    z = f"WITH z AS (SELECT * FROM ({dirty}) WHERE seq = 0)"
    so_far = "(PARTITION BY ticker ORDER BY date)"
    carry = lambda c: f"arg_max({c}, date) FILTER ({c} IS NOT NULL) OVER {so_far}"
    quiet = lambda src: f"SELECT ticker, date, {', '.join(f'if(jump, NULL, {c}) AS {c}' for c in _FIVE[:4])}, volume FROM (SELECT *, ifnull(abs(now / lag(now) OVER {so_far} - 1) > 0.5, false) AS jump FROM (SELECT *, {carry('close')} AS now FROM {src}))"
    holes = " + ".join(f"({c} IS NULL)::INT" for c in _FIVE)
    bad = " OR ".join(f"ifnull({c} = 0, true)" for c in _FIVE[:4])
    fit = "min(close) >= 0.01 AND max(close) <= 1000000"
    clean = f"""WITH one AS (SELECT ticker, date, {', '.join(f'arg_max(if({c} < 0, NULL, {c}), seq) FILTER (seq = top) AS {c}' for c in _FIVE)} FROM (SELECT *, max(seq) OVER (PARTITION BY ticker, date) AS top FROM ({dirty})) GROUP BY ALL),
fixed AS (SELECT ticker, date, open, greatest(high, open, close) AS high, least(low, open, close) AS low, close, volume FROM one), q AS ({quiet('fixed')}),
keep AS (SELECT ticker FROM q GROUP BY ticker HAVING sum({holes}) / (5e0 * count(*)) <= 0.1),
f AS (SELECT ticker, date, {', '.join(f'{carry(c)} AS {c}' for c in _FIVE)} FROM q SEMI JOIN keep USING (ticker)), r AS (SELECT ticker, date, open, high, low, close, ifnull(volume, 0) AS volume FROM f WHERE close IS NOT NULL),
good AS (SELECT ticker FROM r JOIN (SELECT ticker, count(*) AS n FROM ({dirty}) GROUP BY ticker) USING (ticker) GROUP BY ticker HAVING {fit} AND count(*) >= any_value(n) / 2e0 AND NOT bool_or({bad}))"""
    return {
        "c01_clean_ohlcv": f"{clean} SELECT * FROM r SEMI JOIN good USING (ticker)",
        "c02_fix_ohlc": f"{z} SELECT ticker, date, open, list_max([high, open, close]) AS high, list_min([low, open, close]) AS low, close, volume FROM z",
        "c03_price_outliers": f"{z} {quiet('z')}",
        "c04_validate": f"SELECT ticker, count(*) AS n_rows, count(*) FILTER ({bad}) AS n_bad, round(min(close), 6) AS lo, round(max(close), 6) AS hi, NOT bool_or({bad}) AND {fit} AS valid FROM ({dirty}) GROUP BY ticker",
        "c05_forward_fill": f"{z} SELECT ticker, date, {', '.join(f'{carry(c)} AS {c}' for c in _FIVE)} FROM z",
        "c08_clean_universe": f"{clean} SELECT ticker, count(*) AS n_rows, min(date) AS first_day, max(date) AS last_day FROM r SEMI JOIN good USING (ticker) GROUP BY ticker",
        "c09_returns": over_bars("round(r, 8) + 0.0 AS ret, round(l, 8) + 0.0 AS log_ret"),
        "c10_forward_returns": f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM ({BARS_SQL}))
SELECT b.ticker, b.date, {', '.join(f'round(x{h}.close / b.close - 1, 8) + 0.0 AS fwd_{h}d' for h in (1, 5, 10, 21))} FROM b {' '.join(f'LEFT JOIN b x{h} ON x{h}.ticker = b.ticker AND x{h}.i = b.i + {h}' for h in (1, 5, 10, 21))}""",
        "c11_build_panel": f"SELECT ticker, date, open, high, low, close, volume FROM ({BARS_SQL}) WHERE date >= DATE '1995-01-02' AND date < DATE '1999-01-01'",
        "c14_market_check": f"""{z}, a AS (SELECT ticker, arg_max(close, date) AS c, list(close * volume ORDER BY date DESC)[1:21] AS v, sum({holes}) / (5e0 * count(*)) AS m FROM (SELECT *, close IS NULL AS gone FROM z) GROUP BY ticker)
SELECT ticker, round(c, 6) AS last_close, round(list_avg(v), 4) AS dollars, round(m, 8) AS missing, ifnull(c >= 5 AND list_avg(v) >= 1000000 AND m <= 0.1, false) AS passed FROM a""",
        "c16_drop_incomplete": f"{z} SELECT ticker, date, open, high, low, close, volume FROM z WHERE ({holes}) = 0",
        "c17_fill_zero": f"{z} SELECT ticker, date, {', '.join(f'ifnull({c}, 0) AS {c}' for c in _FIVE)} FROM z",
    }


def _filter(d: float, least: float, x: str = "ln(close)", padded: bool = False) -> str:
    """A fractional filter as a dot product of its weights and the last values; short histories have none, or shorter ones."""
    weights = [1.0]
    while abs(w := weights[-1] * (len(weights) - 1 - d) / len(weights)) >= least:
        weights.append(w)
    over = f"(PARTITION BY ticker ORDER BY date ROWS {len(weights) - 1} PRECEDING)"
    if padded:
        return f"list_inner_product(list({x}) OVER {over}, ({weights[::-1]!r}::DOUBLE[])[-(count(*) OVER {over}) :])"
    return f"CASE WHEN count(*) OVER {over} = {len(weights)} THEN list_inner_product(list({x}) OVER {over}, {weights[::-1]!r}::DOUBLE[]) END"


def indicators() -> dict[str, str]:
    """Bands and relative strengths from sums; filters as dot products of lists; running moments from running sums."""
    short = lambda d: f"round({_filter(d, 1e-3)}, 7) + 0.0 AS log_price_d0_{round(10 * d)}"
    from_bars = lambda columns: f"SELECT ticker, date, {columns} FROM ({BARS_SQL})"
    spread = lambda x, k: f"sqrt({whole('var_samp', x, k)})"
    run = "(PARTITION BY ticker ORDER BY date)"
    z = lambda c: f"({c} - avg({c}) OVER {run}) / (sqrt(var_samp({c}) OVER {run}) + 1e-10)"
    return {
        "f02_fracdiff": from_bars(short(0.5)),
        "f03_fracdiff_multi": from_bars(", ".join(short(d) for d in (0.4, 0.5, 0.6))),
        "f05_fracdiff_valid": f"SELECT * FROM ({from_bars(short(0.5))}) WHERE log_price_d0_5 IS NOT NULL",
        "f07_fracdiff_padded": from_bars(f"round({_filter(0.5, 1e-3, padded=True)}, 7) + 0.0 AS log_price_d0_5_padded"),
        "i01_rsi_sma": over_bars(
            shown({"rsi": f"100 - 100 / (1 + {whole('sum', 'u', 14)} / 14 / ({whole('sum', 'd', 14)} / 14 + 1e-10))"}, 4), "close - lag(close) OVER o AS m",
            "if(m IS NULL, NULL, greatest(m, 0)) AS u, if(m IS NULL, NULL, greatest(-m, 0)) AS d",
        ),
        "i04_bollinger": over_bars(
            shown({"bb_mid": "m", "bb_upper": "m + 2 * s", "bb_lower": "m - 2 * s", "bb_position": "if(s > 1e-9, (close - m) / s, 0 * s)"}, 5), f"{whole('sum', 'close', 20)} / 20 AS m, {spread('close', 20)} AS s"
        ),
        "i04_bollinger_positions": over_bars(shown({f"bb_position_{k}": f"(close - {whole('avg', 'close', k)}) / ({spread('close', k)} + 1e-10)" for k in (20, 50)}, 5)),
        "i05_rolling_stats": over_bars(
            ", ".join(f"round({whole('sum', 'close', k)} / {k}, 7) + 0.0 AS mean_{k}, round({spread('close', k)}, 5) + 0.0 AS std_{k}, round({whole('var_samp', 'close', k)}, 3) + 0.0 AS var_{k}" for k in (10, 20, 50))
        ),
        "i07_momentum": over_bars(shown({f"momentum_{k}": f"close / lag(close, {k}) OVER o - 1" for k in (5, 10, 20)})),
        "i08_volume_ratios": over_bars(shown({"volume_ratio": f"20 * volume / nullif({whole('sum', 'volume', 20)}, 0)", "volume_volatility": f"{spread('volume', 20)} / ({whole('avg', 'volume', 20)} + 1e-10)"}, 5)),
        "i13_expanding_zscore": from_bars(f"round({z('close')}, 5) + 0.0 AS close_z, round({z('volume')}, 5) + 0.0 AS volume_z"),
    }


def trades(scored: str, fills: str, weights: str, hard: str) -> dict[str, str]:
    s = f"WITH s AS ({scored}), k AS (SELECT * FROM s WHERE signal IS NOT NULL)"
    return {
        "b01_align": f"""{s} SELECT ticker, date, round(signal, 7) AS signal, fwd FROM s SEMI JOIN k USING (ticker) SEMI JOIN (SELECT date FROM k INTERSECT SELECT date FROM s WHERE fwd IS NOT NULL) d USING (date)""",
        "b13_twap": f"SELECT ticker, date, k::INT AS slice, round(close * volume / 5, 6) AS value FROM ({fills}), range(1, 6) x(k)",
        "b14_slippage": f"SELECT ticker, date, round(close * volume * (0.0002 + vol / 2), 6) AS slippage FROM ({fills})",
        "b15_borrow_costs": f"SELECT ticker, date, round(-weight * 10000000e0 * if(ticker IN (SELECT ticker FROM ({hard})), 0.1, 0.003) / 252, 9) AS fee FROM ({weights}) WHERE weight < 0",
    }


def feature_table(families: dict[str, list[str]], own: dict[str, str], surprise: str) -> str:
    """The families' own oracles side by side, and long filters as dot products of lists of weights and log prices."""
    seen, parts = set(), []
    for name, columns in families.items():
        fresh = [c for c in columns if c not in seen]
        seen.update(fresh)
        parts.append(f"(SELECT ticker, date, {', '.join(fresh)} FROM ({own[name]}))")
    filters = [f"round({_filter(d, 1e-5)}, 6) + 0.0 AS log_price_d0_{round(10 * d)}" for d in (0.2, 0.3, 0.4, 0.5)]
    parts += [f"({surprise})", f"(SELECT ticker, date, {', '.join(filters)} FROM ({BARS_SQL}))"]
    return "SELECT * FROM " + " JOIN ".join(p + (" USING (ticker, date)" if i else "") for i, p in enumerate(parts))


def long_filters() -> dict[str, str]:
    """The filters of hundreds of weights."""
    of = lambda *ds, padded=False: f"SELECT ticker, date, {', '.join(f'round({_filter(d, 1e-5, padded=padded)}, 6) AS d0_{round(10 * d)}' for d in ds)} FROM ({BARS_SQL})"
    return {
        "f02_fracdiff_long": of(0.2, 0.5),
        "f03_fracdiff_multi_long": of(0.4, 0.5, 0.6),
        "f05_fracdiff_valid_long": f"SELECT * FROM ({of(0.5)}) WHERE d0_5 IS NOT NULL",
        "f07_fracdiff_padded_long": of(0.5, padded=True),
    }


def flow() -> dict[str, str]:
    """Volume split by the normal curve's approximation, its imbalance over frames spelled out, and regressions from their sums."""
    split = (
        "close - lag(close) OVER o AS m, if(count(l) OVER w20 = 20 AND max(l) OVER w20 > min(l) OVER w20, sqrt(var_pop(l) OVER w20) * close, NULL) AS s",
        "m / s AS z", "volume * (1 + if(z < 0, -1, 1) * sqrt(1 - exp(-2 * z * z / pi()))) / 2 AS b", "volume - b AS q, row_number() OVER o AS n",
    )

    def vpin(frame: str, least: int) -> str:
        w = f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN {frame})"
        return f"if(n < {least}, NULL, abs(sum(b - q) OVER {w}) / nullif(sum(b + q) OVER {w}, 0))"

    one = vpin("19 PRECEDING AND CURRENT ROW", 20)
    before = "(PARTITION BY ticker ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)"
    return {
        "v01_bulk_volume": over_bars(shown({"buy_volume": "b", "sell_volume": "q", "order_imbalance": "(b - q) / (b + q + 1e-10)"}, 5), *split),
        "v02_vpin": over_bars(
            shown({"vpin_b1": one, "vpin_b5": vpin("95 PRECEDING AND 4 FOLLOWING", 100), "vpin_b5_causal": vpin("99 PRECEDING AND CURRENT ROW", 100)}, 5), *split
        ),
        "v03_vpin_features": over_bars(
            shown({"buy_volume_pct": "b / nullif(volume, 0)", "vpin_change_5d": "v - lag(v, 5) OVER o", "vpin_zscore_21d": f"(v - {whole('avg', 'v', 21)}) / nullif(sqrt({whole('var_samp', 'v', 21)}), 0)"}, 5), *split, f"{one} AS v"
        ),
        "v09_vol_price_corr": over_bars(
            shown({"vol_price_corr": "if(count(x) OVER w63 = 63, regr_sxy(x, d) OVER w63 / sqrt(regr_sxx(x, d) OVER w63 * regr_syy(x, d) OVER w63), NULL)"}, 5),
            f"sqrt(252 * {whole('var_samp', 'l', 21)}) AS v", "v - lag(v) OVER o AS d", "if(d IS NULL, NULL, l) AS x",
        ),
        "i10_market_neutral": f"""WITH b AS ({BARS_SQL}), m AS (SELECT date, c / lag(c) OVER (ORDER BY date) - 1 AS m FROM (SELECT date, avg(close) AS c FROM b GROUP BY date)),
r AS (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM b),
j AS (SELECT *, if(m IS NULL, NULL, r) AS y, if(r IS NULL, NULL, m) AS x FROM r JOIN m USING (date)),
c AS (SELECT *, avg(x) OVER w AS mx, avg(y) OVER w AS my, covar_pop(y, x) OVER w / var_pop(x) OVER w AS beta, count(x) OVER w AS k FROM j WINDOW w AS {before})
SELECT ticker, date, round(if(n > 252 AND k >= 20, r - my - beta * (m - mx), NULL), 6) + 0.0 AS neutral_return FROM c""",
    }


def portfolio(orders: str, volumes: str) -> str:
    """Cost parts of signed trades; the impact is value^2 over a root, in basis points, and none without a known volume."""
    return f"""WITH o AS (SELECT ticker, abs(trade_value) AS v FROM ({orders})), c AS (SELECT ticker, v, v * 0.00075 AS f, v * 0.0002 AS s, ifnull(if(adv > 0, v * v / sqrt(1e6 * adv) / 100000, 0), 0) AS i
FROM o LEFT JOIN ({volumes}) USING (ticker)) SELECT ticker, round(v, 4) AS trade_value, round(f, 8) AS fixed_cost, round(s, 8) AS spread_cost, round(i, 8) AS impact_cost, round(f + s + i, 8) AS total_cost FROM c"""
