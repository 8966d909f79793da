"""Liquidity and order-flow features of a (ticker, date) panel."""

from __future__ import annotations

from loomframe.functions.sqlsteps import Steps, frame, lag, last, ratio, rolling, rounded

RET = {"ret": f"close / {lag('close')} - 1"}


def amihud(windows=(21, 63)) -> Steps:
    illiq = {"illiq": ratio("abs(ret)", "close * volume")}
    mean = {f"amihud_{k}d": rolling("avg", "illiq", k) for k in windows} | {f"sd_{k}": rolling("stddev_samp", "illiq", k) for k in windows}
    z = {f"amihud_zscore_{k}d": ratio(f"illiq - amihud_{k}d", f"sd_{k}") for k in windows}
    out = [*[f"amihud_{k}d" for k in windows], *z]
    return Steps([RET, illiq, mean, z], out, digits={c: 5 if "zscore" in c else 13 for c in out})


def kyle_lambda(windows=(21, 63)) -> Steps:
    flow = {"sv": "CASE WHEN ret IS NULL THEN NULL ELSE sign(ret) * volume END"}
    out = {}
    for k in windows:
        w = last(k)
        out[f"kyle_lambda_{k}d"] = f"CASE WHEN count(*) {w} = {k} AND count(sv) {w} >= 3 AND max(sv) {w} > min(sv) {w} THEN regr_slope(ret, sv) {w} END"
    return Steps([RET, flow, out], digits=rounded(out, 10))


def order_flow(windows=(5, 21)) -> Steps:
    rng = {"range_imbalance": "CASE WHEN high = low THEN 0.0 ELSE (close - low) / (high - low) - 0.5 END", "pos": "(close - low) / (high - low + 1e-10)"}
    vol = {"volume_imbalance": ratio("volume * pos - volume * (1 - pos)", "volume")}
    cum = {f"cum_imbalance_{k}d": rolling("sum", "volume_imbalance", k) for k in windows}
    cum |= {f"imbalance_trend_{k}d": rolling("avg", "volume_imbalance", k) for k in windows}
    out = ["range_imbalance", "volume_imbalance", *cum]
    return Steps([rng, vol, cum], out, digits=rounded(out, 5))


def roll_spread(k: int = 21) -> Steps:
    both = {"r1": lag("ret")}
    pair = {"ra": "CASE WHEN r1 IS NOT NULL THEN ret END"}
    cov = {"cv": f"CASE WHEN count(ra) {last(k)} = {k} THEN covar_samp(ra, r1) {last(k)} END"}
    out = {"roll_spread": "CASE WHEN cv IS NOT NULL THEN sqrt(-4 * least(0.0, cv)) END"}
    return Steps([RET, both, pair, cov, out], digits=rounded(out, 5))


def corwin_schultz(total: bool = False) -> Steps:
    """High-low spread from the mean of two days' squared log ranges and that of both days together, in [0, 0.1].

    The mean never exceeds the range of both days, so the value is 0 wherever high and low are known; `total` takes the
    sum of the two days, as the estimator was published.
    """
    one = {"b1": "power(ln(high / low), 2)", "h2": rolling("max", "high", 2), "l2": rolling("min", "low", 2)}
    two = {"beta": rolling("sum" if total else "avg", "b1", 2), "gamma": "power(ln(h2 / l2), 2)"}
    three = {"alpha": "(sqrt(2 * beta) - sqrt(beta)) / (3 - 2 * sqrt(2.0)) - sqrt(gamma / (3 - 2 * sqrt(2.0)))"}
    out = {"cs_spread": "CASE WHEN alpha IS NOT NULL THEN least(0.1, 2 * (exp(greatest(alpha, 0.0)) - 1) / (1 + exp(greatest(alpha, 0.0)))) END"}
    return Steps([one, two, three, out], digits=rounded(out))


def hl_spread() -> Steps:
    return Steps([{"hl_spread": "(high - low) / close"}], digits={"hl_spread": 8})


def volume_hhi(windows=(21, 63)) -> Steps:
    share = {f"share2_{k}": f"power(volume / nullif({rolling('sum', 'volume', k)}, 0), 2)" for k in windows}
    out = {f"volume_hhi_{k}d": rolling("sum", f"share2_{k}", k) for k in windows}
    return Steps([share, out], digits=rounded(out))


def up_down_volume(windows=(21, 63)) -> Steps:
    parts = {"up": "CASE WHEN ret > 0 THEN volume ELSE CAST(0 AS DOUBLE) END", "down": "CASE WHEN ret > 0 THEN CAST(0 AS DOUBLE) ELSE volume END"}
    sums = {f"{c}_{k}": rolling("sum", c, k) for k in windows for c in parts}
    out = {f"up_down_volume_{k}d": f"(up_{k} - down_{k}) / (up_{k} + down_{k} + 1e-10)" for k in windows}
    return Steps([RET, parts, sums, out], digits=rounded(out, 7))


def liquidity_vol(windows=(21, 63)) -> Steps:
    illiq = {"illiq": ratio("abs(ret)", "close * volume")}
    out = {f"volume_vol_{k}d": ratio(rolling("stddev_samp", "volume", k), f"({rolling('avg', 'volume', k)})") for k in windows}
    out |= {f"illiq_vol_{k}d": rolling("stddev_samp", "illiq", k) for k in windows}
    return Steps([RET, illiq, out], digits={c: 13 if c.startswith("illiq") else 5 for c in out})


def volume_autocorr(windows=(21, 63)) -> Steps:
    prev = {"v1": lag("volume")}
    out = {}
    for k in windows:
        w = frame(-(k - 2), 0)
        flat = f"max(volume) {w} = min(volume) {w} OR max(v1) {w} = min(v1) {w}"
        out[f"volume_autocorr_{k}d"] = f"CASE WHEN count(volume) {last(k)} = {k} AND NOT ({flat}) THEN corr(volume, v1) {w} END"
    return Steps([prev, out], digits=rounded(out, 5))


def flow_pressure() -> Steps:
    out = {"quote_pressure": "2 * (close - low) / (high - low + 1e-10) - 1", "ofi": "(2 * (close - low) / (high - low + 1e-10) - 1) * volume"}
    return Steps([out], digits=rounded(out, 5))


def vwap_distance(k: int = 20) -> Steps:
    tv = {"tv": "(high + low + close) / 3 * volume"}
    vwap = {"vwap": f"({rolling('sum', 'tv', k)}) / nullif({rolling('sum', 'volume', k)}, 0)"}
    out = {"vwap_distance": "(close - vwap) / (vwap + 1e-10)"}
    return Steps([tv, vwap, out], digits=rounded(out))


FAMILIES = {
    "m01_amihud": amihud, "m02_kyle_lambda": kyle_lambda, "m03_m05_order_flow": order_flow, "m06_roll_spread": roll_spread,
    "m07_corwin_schultz": corwin_schultz, "m08_hl_spread": hl_spread, "m09_volume_hhi": volume_hhi, "m10_up_down_volume": up_down_volume,
    "m11_liquidity_vol": liquidity_vol, "m12_volume_autocorr": volume_autocorr, "m13_flow_pressure": flow_pressure, "m14_vwap_distance": vwap_distance,
}
