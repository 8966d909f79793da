"""Fractional differencing, exponential means, indicators, entropy, neutralisation and intermarket features."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.functions.sqlsteps import Steps, frame, lag, last, rolling, rounded
from loomframe.functions.template import Template

# --- fractional differencing


def ffd_weights(d: float, threshold: float = 1e-5) -> list[float]:
    """Newest first: 1, then each from the one before, until below the threshold."""
    w = [1.0]
    while abs(nxt := -w[-1] * (d - len(w) + 1) / len(w)) >= threshold:
        w.append(nxt)
    return w


def fracdiff(ds=(0.4, 0.5), threshold: float = 1e-3, x: str = "ln(close)", padded: bool = False) -> Steps:
    """Short filters as one expression of lags: all of them share the panel's window.

    The first len(w) - 1 rows are null; `padded` takes what is missing as 0 instead.
    """
    out, lags = {}, {}
    for d in ds:
        w = ffd_weights(d, threshold)
        lags |= {f"l{k}": lag("x", k) for k in range(1, len(w))}
        term = lambda k: "x" if not k else f"coalesce(l{k}, 0)" if padded else f"l{k}"
        name = f"log_price_d{d:g}".replace(".", "_") + "_padded" * padded
        out[name] = " + ".join(f"{wk!r} * {term(k)}" if "e" in repr(wk) else f"{wk!r}e0 * {term(k)}" for k, wk in enumerate(w))
    return Steps([{"x": x}, lags, out], digits=rounded(out, 7))


def fracdiff_long(panel: DataFrame, ds: tuple[float, ...] = (0.2, 0.5), threshold: float = 1e-5, x: str = "ln(close)", padded: bool = False) -> DataFrame:
    """Filters of hundreds to thousands of weights: one convolution a ticker and d, on Arrow batches of one ticker.

    The first len(w) - 1 rows are null; `padded` takes what is missing as 0 instead.
    """
    filters = {f"d{d:g}".replace(".", "_"): np.array(ffd_weights(d, threshold)) for d in ds}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        for name, w in filters.items():
            y = np.full(len(pdf), np.nan)
            if padded:
                y = np.convolve(pdf.x.to_numpy(), w)[: len(pdf)]
            elif len(pdf) >= len(w):
                y[len(w) - 1 :] = np.convolve(pdf.x.to_numpy(), w, "valid")
            pdf[name] = y
        return pdf.drop(columns="x")

    src = panel.select("ticker", "date", F.expr(x).alias("x"))
    out = src.groupBy("ticker").applyInPandas(run, "ticker string, date date, " + ", ".join(f"{n} double" for n in filters))
    return out.select("ticker", "date", *[F.nanvl(n, F.lit(None)).alias(n) for n in filters])


#: MacKinnon's response surface for the ADF test with a constant, 5 percent.
ADF_5 = (-2.86154, -2.8903, -4.234, -40.04)


def adf_statistic(x: np.ndarray) -> tuple[float, int]:
    """t statistic of the lagged level with a constant and one lagged difference, and the rows used."""
    dx = np.diff(x)
    y = dx[1:]
    z = np.column_stack([np.ones(len(y)), x[1:-1], dx[:-1]])
    beta, *_ = np.linalg.lstsq(z, y, rcond=None)
    e = y - z @ beta
    s2 = e @ e / (len(y) - z.shape[1])
    return float(beta[1] / math.sqrt(s2 * np.linalg.inv(z.T @ z)[1, 1])), len(y)


def stationary(x: np.ndarray) -> bool:
    x = x[np.isfinite(x)]
    if len(x) < 20 or x.max() == x.min():
        return False
    t, n = adf_statistic(x)
    return t < sum(c / n**i for i, c in enumerate(ADF_5))


def find_min_d(panel: DataFrame, threshold: float = 1e-5, steps: int = 20, close_enough: float = 0.01) -> DataFrame:
    """(ticker, min_d): the middle of the bracket, under close_enough wide, at which bisection of [0, 1] leaves the d from
    which the differenced log price is stationary."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.log(pdf.sort_values("date").close.to_numpy())
        lo, hi = 0.0, 1.0
        for _ in range(steps):
            mid = (lo + hi) / 2
            w = np.array(ffd_weights(mid, threshold))
            ok = len(x) >= len(w) and stationary(np.convolve(x, w, "valid"))
            lo, hi = (lo, mid) if ok else (mid, hi)
            if hi - lo < close_enough:
                break
        return pd.DataFrame({"ticker": [pdf.ticker.iloc[0]], "min_d": [(lo + hi) / 2]})

    return panel.select("ticker", "date", "close").groupBy("ticker").applyInPandas(run, "ticker string, min_d double")


# --- exponential means: recurrences over one ticker's rows


def _recurrence(panel: DataFrame, columns: dict[str, object]) -> DataFrame:
    """One pass a ticker; columns: name -> function of the ordered frame to an array."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        return pd.DataFrame({"ticker": pdf.ticker, "date": pdf.date, **{n: f(pdf) for n, f in columns.items()}})

    ddl = "ticker string, date date, " + ", ".join(f"{n} double" for n in columns)
    out = panel.select("ticker", "date", "close").groupBy("ticker").applyInPandas(run, ddl)
    return out.select("ticker", "date", *[F.round(F.nanvl(n, F.lit(None)), 5).alias(n) for n in columns])


def ewm(panel: DataFrame, span: int = 63) -> DataFrame:
    """Weighted mean of the whole past, weights (1 - a)^i scaled to sum 1, a = 2 / (span + 1)."""
    return _recurrence(panel, {f"ewm_{span}": lambda p: p.close.ewm(span=span, adjust=True).mean().to_numpy()})


def ema(panel: DataFrame, span: int = 20) -> DataFrame:
    """y = a x + (1 - a) y before, from the first value on."""
    return _recurrence(panel, {f"ema_{span}": lambda p: p.close.ewm(span=span, adjust=False).mean().to_numpy()})


def vol_surprise(panel: DataFrame, k: int = 21, span: int = 63) -> DataFrame:
    """Annualised realised volatility of k rows less its own exponential mean."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        rv = np.log(pdf.close).diff().rolling(k).std() * math.sqrt(252)
        return pd.DataFrame({"ticker": pdf.ticker, "date": pdf.date, "vol_surprise": rv - rv.ewm(span=span, adjust=True).mean()})

    out = panel.select("ticker", "date", "close").groupBy("ticker").applyInPandas(run, "ticker string, date date, vol_surprise double")
    return out.select("ticker", "date", (F.round(F.nanvl("vol_surprise", F.lit(None)), 6) + 0.0).alias("vol_surprise"))


def macd(panel: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Difference of two means, its own mean, and what is left, for both kinds of exponential mean."""

    def parts(adjust: bool, k: int):
        def run(p):
            e = lambda x, s: x.ewm(span=s, adjust=adjust).mean()
            line = e(p.close, fast) - e(p.close, slow)
            sig = e(line, signal)
            return (line, sig, line - sig)[k].to_numpy()

        return run

    names = ("macd", "macd_signal", "macd_hist")
    return _recurrence(panel, {n + tail: parts(adjust, k) for adjust, tail in ((True, "_adj"), (False, "")) for k, n in enumerate(names)})


def rsi_wilder(panel: DataFrame, k: int = 14) -> DataFrame:
    """Seeded with the mean of the first k moves, then (a (k - 1) + x) / k; 100 where nothing was lost."""

    def run(p):
        move = np.diff(p.close.to_numpy())
        out = np.full(len(p), np.nan)
        if len(move) >= k:
            up, down = np.maximum(move, 0), np.maximum(-move, 0)
            g, loss = up[:k].mean(), down[:k].mean()
            for i in range(k, len(move) + 1):
                if i > k:
                    g, loss = (g * (k - 1) + up[i - 1]) / k, (loss * (k - 1) + down[i - 1]) / k
                out[i] = 100.0 if loss == 0 else 100 - 100 / (1 + g / loss)
        return out

    return _recurrence(panel, {f"rsi_{k}": run})


# --- window indicators


def rsi_sma(k: int = 14, from_first: bool = False) -> Steps:
    """RSI from plain means of gains and losses; `from_first` counts a ticker's first row as a move of 0."""
    move = {"dc": f"coalesce(close - {lag('close')}, 0.0)" if from_first else f"close - {lag('close')}"}
    sides = {"up": "CASE WHEN dc > 0 THEN dc WHEN dc IS NOT NULL THEN 0.0 END", "down": "CASE WHEN dc < 0 THEN -dc WHEN dc IS NOT NULL THEN 0.0 END"}
    sides = {c: f"CAST({e} AS DOUBLE)" for c, e in sides.items()}
    means = {"au": rolling("avg", "up", k), "ad": rolling("avg", "down", k)}
    out = {"rsi": "100 - 100 / (1 + au / (ad + 1e-10))"}
    return Steps([move, sides, means, out], digits=rounded(out, 4))


def bollinger_positions(windows=(20, 50)) -> Steps:
    """Distance of the close from its mean in deviations, with a small addend for the divisor in place of a rule for 0."""
    out = {f"bb_position_{k}": f"(close - ({rolling('avg', 'close', k)})) / (({rolling('stddev_samp', 'close', k)}) + 1e-10)" for k in windows}
    return Steps([out], digits=rounded(out, 5))


def bollinger(k: int = 20) -> Steps:
    base = {"mid": rolling("avg", "close", k), "sd": rolling("stddev_samp", "close", k)}
    out = {"bb_mid": "mid", "bb_upper": "mid + 2 * sd", "bb_lower": "mid - 2 * sd", "bb_position": "CASE WHEN sd > 1e-9 THEN (close - mid) / sd WHEN sd IS NOT NULL THEN 0.0 END"}
    return Steps([base, out], digits=rounded(out, 5))


def rolling_stats(windows=(10, 20, 50)) -> Steps:
    out = {f"{n}_{k}": rolling(f, "close", k) for k in windows for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("var", "var_samp"))}
    return Steps([out], digits={c: {"mean": 7, "std": 5, "var": 3}[c.split("_")[0]] for c in out})


def momentum(windows=(5, 10, 20)) -> Steps:
    out = {f"momentum_{k}": f"close / {lag('close', k)} - 1" for k in windows}
    return Steps([out], digits=rounded(out))


def volume_ratios(k: int = 20) -> Steps:
    base = {"av": rolling("avg", "volume", k), "sv": rolling("stddev_samp", "volume", k)}
    out = {"volume_ratio": "volume / nullif(av, 0)", "volume_volatility": "sv / (av + 1e-10)"}
    return Steps([base, out], digits=rounded(out, 5))


def notebook_vols(k: int = 20) -> Steps:
    """Realised volatility of simple returns, and Parkinson's as a mean of each row's own root."""
    base = {"ret": f"close / {lag('close')} - 1", "pk": "sqrt(power(ln(high / low), 2) / (4 * ln(2.0)))"}
    out = {"realized_vol": f"({rolling('stddev_samp', 'ret', k)}) * sqrt(252.0)", "parkinson_vol": f"({rolling('avg', 'pk', k)}) * sqrt(252.0)"}
    return Steps([base, out], digits=rounded(out))


def expanding_zscore(columns=("close", "volume")) -> Steps:
    w = frame(None, 0)
    out = {f"{c}_z": f"({c} - avg({c}) {w}) / (stddev_samp({c}) {w} + 1e-10)" for c in columns}
    return Steps([out], digits=rounded(out, 5))


def entropy(panel: DataFrame, k: int = 20, bins: int = 10, least: int | None = None) -> DataFrame:
    """Shannon entropy (nats) of the last k simple returns in `bins` equal bins from their least to their largest value.
    All k must be known; with `least` the known ones of the last k rows count where there are so many.

    A value's bin is the number of inner edges at or below it, so the last bin is closed. Only the k values of a
    row's own window are held at a time.
    """
    w, over = last(k), "OVER (PARTITION BY ticker ORDER BY date)"
    r = panel.selectExpr("ticker", "date", f"close / lag(close) {over} - 1 AS r")
    s = r.selectExpr("ticker", "date", f"CASE WHEN {f'count(*) {w} = {k} AND count(r) {w} >= {least}' if least else f'count(r) {w} = {k}'} THEN collect_list(r) {w} END AS xs", f"min(r) {w} AS lo", f"max(r) {w} AS hi")
    edges = f"transform(sequence(1, {bins - 1}), q -> lo + q * ((hi - lo) / {bins}))"
    s = s.selectExpr("ticker", "date", "lo", "hi", "xs", f"{edges} AS es").selectExpr(
        "ticker", "date", "lo", "hi", "transform(xs, x -> size(filter(es, e -> e <= x))) AS bs"
    )
    parts = f"transform(sequence(0, {bins - 1}), b -> CAST(size(filter(bs, y -> y = b)) AS DOUBLE) / size(bs))"
    return s.selectExpr(
        "ticker", "date",
        f"round(CASE WHEN bs IS NULL THEN NULL WHEN lo = hi THEN 0.0 ELSE -aggregate({parts}, CAST(0 AS DOUBLE), (a, p) -> a + CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) END, 6) + 0.0 AS entropy",
    )


def market_neutral(k: int = 252, least: int = 20) -> Template:
    """Residual of the return on the market's, with coefficients from the k rows before (the row itself excluded)."""
    w = f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    return Template(f"""
WITH m AS (SELECT date, avg(close) AS c FROM $panel GROUP BY date), mr AS (SELECT date, c / lag(c) OVER (ORDER BY date) - 1 AS mret FROM m),
r AS (SELECT ticker, date, close / {lag('close')} - 1 AS ret, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i FROM $panel),
j AS (SELECT r.ticker, r.date, ret, mret, i, CASE WHEN mret IS NOT NULL THEN ret END AS y, CASE WHEN ret IS NOT NULL THEN mret END AS x FROM r JOIN mr ON r.date = mr.date),
b AS (SELECT *, regr_slope(y, x) {w} AS beta, regr_intercept(y, x) {w} AS alpha, count(x) {w} AS n FROM j)
SELECT ticker, date, round(CASE WHEN i >= {k} AND n >= {least} THEN ret - alpha - beta * mret END, 6) + 0.0 AS neutral_return FROM b""")


def intermarket_steps() -> Steps:
    """Features of named assets beside the market, over rows (ticker, date, market, rates, dollar, vix, semis, tech)."""
    ret = {
        "rates_diff": f"rates - {lag('rates')}", "dollar_returns": f"ln(dollar / {lag('dollar')})", "semis_returns": f"ln(semis / {lag('semis')})",
        "tech_returns": f"ln(tech / {lag('tech')})", "tech_rel_strength": f"(tech / {lag('tech')} - 1) - (market / {lag('market')} - 1)",
    }
    out = {f"rates_diff_ma{k}": rolling("avg", "rates_diff", k) for k in (5, 20)}
    out |= {f"{a}_momentum_{k}": f"{a} / {lag(a, k)} - 1" for a, k in (("dollar", 10), ("vix", 5), ("semis", 10), ("semis", 20), ("tech", 10))}
    out |= {f"{a}_volatility": f"({rolling('stddev_samp', f'{a}_returns', 20)}) * sqrt(252.0)" for a in ("dollar", "semis", "tech")}
    out |= {"vix_level": "vix", "vix_pct_change": f"vix / {lag('vix')} - 1", "tech_rel_strength_ma10": rolling("avg", "tech_rel_strength", 10)}
    out["vix_zscore"] = f"(vix - ({rolling('avg', 'vix', 252)})) / (({rolling('stddev_samp', 'vix', 252)}) + 1e-10)"
    columns = [*ret, *out]
    return Steps([ret, out], columns, keys=("date",), digits={c: 5 if c in ("vix_level", "vix_zscore") or c.startswith("rates") else 6 for c in columns})


def intermarket() -> Template:
    """Those features on the dates that all of them have; $assets has (asset, date, close)."""
    names = ("market", "rates", "dollar", "vix", "semis", "tech")
    wide = ", ".join(f"max(CASE WHEN asset = '{a}' THEN close END) AS {a}" for a in names)
    have = " AND ".join(f"{a} IS NOT NULL" for a in names)
    return Template(intermarket_steps().sql(f"SELECT 'assets' AS ticker, w.* FROM (SELECT date, {wide} FROM $assets GROUP BY date) w WHERE {have}"))


def quantile_signal(k: int = 63, q: float = 0.8) -> Template:
    """Product of two features and a flag where both exceed their own rolling quantile; $panel has vpin and vol."""
    w = last(k)
    top = lambda x: f"CASE WHEN count({x}) {w} = {k} THEN PCTL({x}, {q}) {w} END"
    return Template(f"""WITH q AS (SELECT ticker, date, vpin, vol, {top('vpin')} AS qa, {top('vol')} AS qb FROM $panel)
SELECT ticker, date, round(vpin * vol, 7) AS vpin_vol_interaction, CASE WHEN vpin > qa AND vol > qb THEN 1 ELSE 0 END AS informed_signal FROM q""")


# --- regimes


def fit_regimes(r: np.ndarray, states: int = 3, rounds: int = 1000, close_enough: float = 0.01) -> np.ndarray:
    """Gaussian hidden Markov states of a series, by expectation-maximisation (until the log-likelihood gains less than
    close_enough) and Viterbi, numbered by rising variance; -1 throughout where there are too few values to tell."""
    if len(r) < 10 * states:
        return np.full(len(r), -1)
    mean, var = np.quantile(r, (np.arange(states) + 0.5) / states), np.full(states, r.var() + 1e-12)
    var = var * np.linspace(0.5, 1.5, states)
    move, first = np.full((states, states), 0.05 / max(1, states - 1)), np.full(states, 1 / states)
    np.fill_diagonal(move, 0.95)
    likely = -np.inf
    for _ in range(rounds):
        dens = np.exp(-((r[:, None] - mean) ** 2) / (2 * var)) / np.sqrt(2 * np.pi * var) + 1e-300
        a, scale, b = np.empty_like(dens), np.empty(len(r)), np.ones_like(dens)
        now = first * dens[0]
        for t in range(len(r)):
            now = now if t == 0 else (a[t - 1] @ move) * dens[t]
            scale[t] = now.sum()
            a[t] = now / scale[t]
        before, likely = likely, float(np.log(scale).sum())
        if likely - before < close_enough:
            break
        for t in range(len(r) - 2, -1, -1):
            b[t] = move @ (dens[t + 1] * b[t + 1]) / scale[t + 1]
        g = a * b
        g /= g.sum(1, keepdims=True)
        pair = (a[:-1, :, None] * move * (dens[1:] * b[1:] / scale[1:, None])[:, None, :]).sum(0)
        first, move = g[0], pair / pair.sum(1, keepdims=True)
        mean = (g * r[:, None]).sum(0) / g.sum(0)
        var = (g * (r[:, None] - mean) ** 2).sum(0) / g.sum(0) + 1e-10
    step, best = np.log(move + 1e-300), np.log(first * dens[0] + 1e-300)
    back = np.zeros(dens.shape, int)
    for t in range(1, len(r)):
        options = best[:, None] + step
        back[t], best = options.argmax(0), options.max(0) + np.log(dens[t])
    path = [int(best.argmax())]
    for t in range(len(r) - 1, 0, -1):
        path.append(int(back[t][path[-1]]))
    return np.argsort(np.argsort(var))[path[::-1]]


def hmm_regimes(panel: DataFrame, states: int = 3, rounds: int = 1000) -> DataFrame:
    """(ticker, date, regime, regime_0, ...): fit_regimes of a ticker's simple returns, and an indicator a state; regime is
    null where there is no return or too few of them, with every indicator 0."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        r = pdf.close.pct_change().to_numpy()[1:]
        return pd.DataFrame({"ticker": pdf.ticker, "date": pdf.date, "regime": np.append(-1, fit_regimes(r, states, rounds))})

    out = panel.select("ticker", "date", "close").groupBy("ticker").applyInPandas(run, "ticker string, date date, regime int")
    shown = [(F.col("regime") == F.lit(k)).cast("double").alias(f"regime_{k}") for k in range(states)]
    return out.select("ticker", "date", F.when(F.col("regime") >= 0, F.col("regime")).alias("regime"), *shown)
