"""Returns, momentum, trend and volatility features of a (ticker, date) panel."""

from __future__ import annotations

from loomframe.functions.sqlsteps import Steps, frame, full_rows, lag, last, ratio, rolling, rounded

RETURN_WINDOWS = (5, 10, 21, 63, 126, 252)
VOL_WINDOWS = (63, 252)
YEAR = "sqrt(252.0)"

BASE = {"ret": f"close / {lag('close')} - 1", "lret": f"ln(close / {lag('close')})"}


def zscore(x: str, k: int) -> str:
    """Over k full rows, skipping nulls: 0 where the spread is zero or nothing is there."""
    w = last(k)
    return full_rows(f"CASE WHEN count({x}) {w} = 0 OR max({x}) {w} = min({x}) {w} THEN 0.0 ELSE ({x} - avg({x}) {w}) / stddev_pop({x}) {w} END", k)


def moments(x: str, k: int) -> dict[str, str]:
    """Population raw moments over k rows, for skewness and kurtosis."""
    w = last(k)
    return {f"n_{k}": f"count({x}) {w}", f"m_{k}": f"avg({x}) {w}", f"s_{k}": f"stddev_pop({x}) {w}", f"flat_{k}": f"max({x}) {w} = min({x}) {w}", f"rows_{k}": f"count(*) {w}"}


def central(x: str, k: int, p: int) -> str:
    """The p-th central moment over k rows from power sums of x, shifted by nothing: x is a small return."""
    w = last(k)
    a = lambda q: f"avg({'*'.join([x] * q)}) {w}"
    m = f"m_{k}"
    if p == 3:
        return f"({a(3)} - 3 * {m} * {a(2)} + 2 * {m} * {m} * {m})"
    return f"({a(4)} - 4 * {m} * {a(3)} + 6 * {m} * {m} * {a(2)} - 3 * {m} * {m} * {m} * {m})"


def cum_returns(windows=RETURN_WINDOWS) -> Steps:
    out = {f"cum_ret_{k}d": rolling("sum", "ret", k) for k in windows}
    return Steps([BASE, out], digits=rounded(out))


def return_zscores(windows=RETURN_WINDOWS) -> Steps:
    out = {f"ret_zscore_{k}d": zscore("ret", k) for k in windows}
    out |= {f"volume_zscore_{k}d": zscore("volume", k) for k in (21, 63)}
    return Steps([BASE, out], digits=rounded(out, 5))


def skewness(windows=VOL_WINDOWS) -> Steps:
    level = {c: e for k in windows for c, e in moments("ret", k).items()}
    cubes = {f"c3_{k}": central("ret", k, 3) for k in windows}
    out = {f"skewness_{k}d": f"CASE WHEN rows_{k} = {k} AND n_{k} >= 3 THEN CASE WHEN flat_{k} THEN 0.0 ELSE c3_{k} / power(s_{k}, 3) END END" for k in windows}
    return Steps([BASE, level, cubes, out], digits=rounded(out, 4))


def kurtosis(windows=VOL_WINDOWS) -> Steps:
    level = {c: e for k in windows for c, e in moments("ret", k).items()}
    quads = {f"c4_{k}": central("ret", k, 4) for k in windows}
    out = {f"kurtosis_{k}d": f"CASE WHEN rows_{k} = {k} AND n_{k} >= 4 THEN CASE WHEN flat_{k} THEN 0.0 ELSE c4_{k} / power(s_{k}, 4) - 3 END END" for k in windows}
    return Steps([BASE, level, quads, out], digits=rounded(out, 4))


def realized_vol(windows=VOL_WINDOWS) -> Steps:
    out = {f"realized_vol_{k}d": f"({rolling('stddev_samp', 'lret', k)}) * {YEAR}" for k in windows}
    return Steps([BASE, out], digits=rounded(out))


RANGES = {
    "hl2": "power(ln(high) - ln(low), 2)",
    "gk": "0.5 * power(ln(high) - ln(low), 2) - (2 * ln(2.0) - 1) * power(ln(close) - ln(open), 2)",
    "rs": "(ln(high) - ln(close)) * (ln(high) - ln(open)) + (ln(low) - ln(close)) * (ln(low) - ln(open))",
}


def parkinson_vol(windows=VOL_WINDOWS) -> Steps:
    out = {f"parkinson_vol_{k}d": f"sqrt(({rolling('avg', 'hl2', k)}) / (4 * ln(2.0))) * {YEAR}" for k in windows}
    return Steps([RANGES, out], digits=rounded(out))


def garman_klass_vol(windows=VOL_WINDOWS) -> Steps:
    mean = {f"gk_{k}": rolling("avg", "gk", k) for k in windows}
    out = {f"garman_klass_vol_{k}d": f"CASE WHEN round(gk_{k}, 12) >= 0 THEN sqrt(greatest(gk_{k}, 0.0)) * {YEAR} END" for k in windows}
    return Steps([RANGES, mean, out], digits=rounded(out, 5))


def rogers_satchell_vol(windows=VOL_WINDOWS) -> Steps:
    mean = {f"rs_{k}": rolling("avg", "rs", k) for k in windows}
    out = {f"rogers_satchell_vol_{k}d": f"CASE WHEN rs_{k} IS NOT NULL THEN sqrt(greatest(rs_{k}, 0.0)) * {YEAR} END" for k in windows}
    return Steps([RANGES, mean, out], digits=rounded(out, 5))


def bipower_variation(windows=VOL_WINDOWS) -> Steps:
    pair = {"bp": f"pi() / 2 * abs(lret) * abs({lag('lret')})"}
    out = {f"bipower_var_{k}d": f"({rolling('avg', 'bp', k - 1)}) * 252" for k in windows}
    return Steps([BASE, pair, out], digits=rounded(out))


def reversal(windows=(5, 10, 21)) -> Steps:
    out = {f"reversal_{k}d": rolling("sum", "ret", k, frame(-k, -1)) for k in windows}
    return Steps([BASE, out], digits=rounded(out))


def momentum_5_21() -> Steps:
    out = {"momentum_5_21": f"({rolling('sum', 'ret', 21)}) - ({rolling('sum', 'ret', 5)})"}
    return Steps([BASE, out], digits=rounded(out))


def price_levels(k: int = 252) -> Steps:
    top = {"hi": rolling("max", "close", k), "lo": rolling("min", "close", k)}
    out = {"pct_from_52w_high": "close / hi - 1", "pct_from_52w_low": "close / lo - 1", "price_position_52w": ratio("close - lo", "hi - lo")}
    return Steps([top, out], digits=rounded(out))


def average_true_range(windows=(14, 63)) -> Steps:
    prev = {"pc": lag("close")}
    tr = {"tr": "greatest(high - low, coalesce(abs(high - pc), 0.0), coalesce(abs(low - pc), 0.0))"}
    out = {f"atr_{k}": f"({rolling('avg', 'tr', k)}) / close" for k in windows}
    return Steps([prev, tr, out], digits=rounded(out))


def relative_volume(windows=(21, 63)) -> Steps:
    out = {f"volume_rel_{k}": ratio("volume", f"({rolling('avg', 'volume', k)})") for k in windows}
    return Steps([out], digits=rounded(out))


def price_volume_trend(k: int = 21) -> Steps:
    rv = {"rv": "ret * volume"}
    out = {"pv_trend_21": ratio(rolling("sum", "rv", k), f"({rolling('sum', 'volume', k)})")}
    return Steps([BASE, rv, out], digits=rounded(out, 8))


def vwap_deviation(k: int = 21) -> Steps:
    cv = {"cv": "close * volume"}
    out = {"vwap_deviation": f"close / (({rolling('sum', 'cv', k)}) / nullif({rolling('sum', 'volume', k)}, 0)) - 1"}
    return Steps([cv, out], digits=rounded(out))


def momentum() -> Steps:
    skip = {"c21": lag("close", 21)}
    out = {f"momentum_{k}d": f"c21 / {lag('close', k)} - 1" for k in (63, 126, 252)}
    out |= {"momentum_12_1": f"c21 / {lag('close', 252)} - 1", "momentum_6_1": f"c21 / {lag('close', 126)} - 1"}
    return Steps([skip, out], digits=rounded(out))


def trend_consistency(windows=(21, 63)) -> Steps:
    up = {"up": "CASE WHEN ret > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"}
    out = {f"trend_consistency_{k}d": f"({rolling('avg', 'up', k)}) - 0.5" for k in windows}
    return Steps([BASE, up, out], digits=rounded(out))


def moving_average_flags(windows=(21, 50, 200)) -> Steps:
    means = {f"ma_{k}": rolling("avg", "close", k) for k in (*windows, 63)}
    out = {f"above_ma_{k}": f"CASE WHEN round(close - ma_{k}, 7) > 0 THEN 1 ELSE 0 END" for k in windows}
    out |= {f"dist_from_ma_{k}": f"close / ma_{k} - 1" for k in windows}
    out |= {"ma_21_63_cross": "CASE WHEN round(ma_21 - ma_63, 7) > 0 THEN 1 ELSE 0 END"}
    return Steps([means, out], digits=rounded([c for c in out if c.startswith("dist")]))


FAMILIES = {
    "t01_cum_returns": cum_returns, "t02_return_zscores": return_zscores, "t03_skewness": skewness, "t04_kurtosis": kurtosis,
    "t05_realized_vol": realized_vol, "t06_parkinson_vol": parkinson_vol, "t07_garman_klass_vol": garman_klass_vol,
    "t08_rogers_satchell_vol": rogers_satchell_vol, "t09_bipower_var": bipower_variation, "t10_reversal": reversal,
    "t11_momentum_5_21": momentum_5_21, "t12_price_levels": price_levels, "t13_atr": average_true_range,
    "t14_relative_volume": relative_volume, "t15_pv_trend": price_volume_trend, "t16_vwap_deviation": vwap_deviation,
    "t17_momentum": momentum, "t18_trend_consistency": trend_consistency, "t19_moving_averages": moving_average_flags,
}


def merged(parts: list[Steps]) -> Steps:
    """One chain for several families: levels of equal depth share a projection, columns of equal name are one."""
    seen: dict[str, int] = {}
    levels: list[dict[str, str]] = []
    out, digits = [], {}
    for s in parts:
        base = 0
        for level in s.levels:
            need = base
            for c in level:
                if c in seen:
                    need = max(need, seen[c])
            fresh = {c: e for c, e in level.items() if c not in seen}
            while fresh and len(levels) <= base:
                levels.append({})
            for c, e in fresh.items():
                levels[base][c] = e
                seen[c] = base
            base += 1
        out += [c for c in s.columns if c not in out]
        digits |= s.digits
    return Steps(levels, out, digits=digits)


def compute_all() -> Steps:
    """All technical columns in one pass over the panel."""
    return merged([f() for name, f in FAMILIES.items() if name[:3] <= "t16"])
