"""Informed trading: bulk volume classification, VPIN and moment-adjusted volatility."""

from __future__ import annotations

from loomframe.functions.sqlsteps import Steps, frame, lag, last, rolling, rounded

BVC = [
    {"lret": f"ln(close / {lag('close')})", "dc": f"close - {lag('close')}"},
    {"sig": f"(CASE WHEN count(lret) {last(20)} = 20 AND max(lret) {last(20)} > min(lret) {last(20)} THEN stddev_pop(lret) {last(20)} END) * close"},
    {"z": "dc / sig"},
    {"buy_p": "CASE WHEN z >= 0 THEN 0.5 + 0.5 * sqrt(1 - exp(-2 * z * z / pi())) ELSE 0.5 - 0.5 * sqrt(1 - exp(-2 * z * z / pi())) END"},
    {"buy_volume": "volume * CASE WHEN z IS NOT NULL THEN buy_p END", "sell_volume": "volume * CASE WHEN z IS NOT NULL THEN 1 - buy_p END"},
]


def bulk_volume() -> Steps:
    tail = {"order_imbalance": "(buy_volume - sell_volume) / (buy_volume + sell_volume + 1e-10)"}
    out = ["buy_volume", "sell_volume", "order_imbalance"]
    return Steps([*BVC, tail], out, digits=rounded(out, 5))


def _vpin(bucket: int, n: int = 20, causal: bool = False) -> dict[str, str]:
    """Imbalance over n buckets of `bucket` rows. The frame of the original reaches bucket - 1 rows ahead;
    `causal` ends it at the current row instead."""
    w = frame(-(n * bucket - 1), 0) if causal else frame(-(n - 1) * bucket, bucket - 1)
    name = f"vpin_b{bucket}" + "_causal" * causal
    expr = f"abs(sum(buy_volume) {w} - sum(sell_volume) {w}) / nullif(sum(buy_volume) {w} + sum(sell_volume) {w}, 0)"
    return {name: f"CASE WHEN row_number() OVER (PARTITION BY ticker ORDER BY date) >= {n * bucket} THEN {expr} END"}


def vpin() -> Steps:
    out = _vpin(1) | _vpin(5) | _vpin(5, causal=True)
    return Steps([*BVC, out], digits=rounded(out, 5))


def vpin_features() -> Steps:
    b1 = _vpin(1) | {"buy_volume_pct": "buy_volume / nullif(volume, 0)"}
    out = {
        "vpin_change_5d": f"vpin_b1 - {lag('vpin_b1', 5)}",
        "vpin_zscore_21d": f"(vpin_b1 - ({rolling('avg', 'vpin_b1', 21)})) / nullif({rolling('stddev_samp', 'vpin_b1', 21)}, 0)",
    }
    return Steps([*BVC, b1, out], ["buy_volume_pct", *out], digits=rounded(["buy_volume_pct", *out], 5))


def _sample_moments(k: int) -> list[dict[str, str]]:
    """Bias-corrected skewness g and excess kurtosis q over k full rows of lret; 0 and -3 where it is flat."""
    w = last(k)
    a = lambda p: f"avg({'*'.join(['lret'] * p)}) {w}"
    level = {f"n_{k}": f"count(lret) {w}", f"m_{k}": a(1), f"a2_{k}": a(2), f"a3_{k}": a(3), f"a4_{k}": a(4), f"v_{k}": f"var_pop(lret) {w}", f"flat_{k}": f"max(lret) {w} = min(lret) {w}"}
    m = f"m_{k}"
    g1 = f"(a3_{k} - 3 * {m} * a2_{k} + 2 * {m} * {m} * {m}) / power(v_{k}, 1.5)"
    g2 = f"(a4_{k} - 4 * {m} * a3_{k} + 6 * {m} * {m} * a2_{k} - 3 * {m} * {m} * {m} * {m}) / power(v_{k}, 2) - 3"
    n = float(k)
    skew = f"CASE WHEN n_{k} = {k} THEN CASE WHEN flat_{k} THEN 0.0 ELSE ({g1}) * sqrt({n} * {n - 1}) / {n - 2} END END"
    kurt = f"CASE WHEN n_{k} = {k} THEN CASE WHEN flat_{k} THEN -3.0 ELSE {(n - 1) / ((n - 2) * (n - 3)):.17f} * (({n + 1}) * ({g2}) + 6) END END"
    return [level, {f"g_{k}": skew, f"q_{k}": kurt, f"sd_{k}": f"CASE WHEN n_{k} = {k} THEN stddev_samp(lret) {w} * sqrt(252.0) END"}]


def _moments_of(windows) -> list[dict[str, str]]:
    return [{c: e for level in parts for c, e in level.items()} for parts in zip(*map(_sample_moments, windows), strict=True)]


LRET = {"lret": f"ln(close / {lag('close')})"}


def csi(windows=(21, 63)) -> Steps:
    """Annualised volatility adjusted by the sample's skewness and kurtosis; kurtosis is in excess, and 3 is taken off again."""
    levels = _moments_of(windows)
    adj = {c: e for k in windows for c, e in ((f"skew_adj_{k}", f"g_{k} / 6"), (f"kurt_adj_{k}", f"(q_{k} - 3) / 24"))}
    full = {f"csi_{k}d": f"sd_{k} * (1 + skew_adj_{k} + kurt_adj_{k})" for k in windows}
    out = {f"csi_ratio_{k}": f"csi_{k}d / nullif(sd_{k}, 0)" for k in windows}
    cols = [*adj, *full, *out]
    return Steps([LRET, *levels, adj, full, out], cols, digits=rounded(cols, 6))


def vol_of_vol(windows=(21, 63)) -> Steps:
    inner = {f"rv_{k}": rolling("stddev_samp", "lret", k) for k in windows}
    out = {f"vol_of_vol_{k}d": f"({rolling('stddev_samp', f'rv_{k}', k)}) / nullif({rolling('avg', f'rv_{k}', k)}, 0)" for k in windows}
    return Steps([LRET, inner, out], digits=rounded(out))


def tails(windows=(21, 63)) -> Steps:
    levels = _moments_of(windows)
    out = {c: e for k in windows for c, e in ((f"skew_premium_{k}d", f"-g_{k}"), (f"tail_risk_{k}d", f"q_{k} - 3"))}
    return Steps([LRET, *levels, out], digits=rounded(out, 5))


def vol_asymmetry(windows=(21, 63), min_periods: int | None = None) -> Steps:
    """Deviation of positive less that of negative returns, over that of all; with the default both need a full
    window of one sign, so that the value is missing throughout, `min_periods` asks for fewer."""
    parts = {"pos": "CASE WHEN lret > 0 THEN lret END", "neg": "CASE WHEN lret < 0 THEN lret END"}
    sides = {f"{x}_{k}": f"CASE WHEN count({x}) {last(k)} >= {min_periods or k} THEN stddev_samp({x}) {last(k)} END" for k in windows for x in parts}
    sides |= {f"rv_{k}": rolling("stddev_samp", "lret", k) for k in windows}
    out = {f"vol_asymmetry_{k}d": f"(pos_{k} - neg_{k}) / nullif(rv_{k}, 0)" for k in windows}
    return Steps([LRET, parts, sides, out], digits=rounded(out))


RV = [LRET, {f"rv{k}": f"({rolling('stddev_samp', 'lret', k)}) * sqrt(252.0)" for k in (5, 21, 252)}]


def term_structure() -> Steps:
    out = {"vol_term_slope": "rv5 - rv21", "vol_mean_reversion": "(rv21 - rv252) / nullif(rv252, 0)"}
    return Steps([*RV, out], digits=rounded(out))


def vol_price_corr(k: int = 63) -> Steps:
    w = last(k)
    diff = {"drv": f"rv21 - {lag('rv21')}"}
    pair = {"x": "CASE WHEN drv IS NOT NULL THEN lret END"}
    out = {"vol_price_corr": f"CASE WHEN count(x) {w} = {k} THEN corr(x, drv) {w} END"}
    return Steps([*RV, diff, pair, out], digits=rounded(out, 5))


FAMILIES = {
    "v01_bulk_volume": bulk_volume, "v02_vpin": vpin, "v03_vpin_features": vpin_features, "v04_csi": csi, "v05_vol_of_vol": vol_of_vol,
    "v06_tails": tails, "v07_vol_asymmetry": vol_asymmetry, "v07_vol_asymmetry_min5": lambda: vol_asymmetry((21, 63), 5),
    "v08_term_structure": term_structure, "v09_vol_price_corr": vol_price_corr,
}
