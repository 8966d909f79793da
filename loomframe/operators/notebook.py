"""The single-asset feature table: every feature of one target beside the named assets, z-scored, with its targets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.functions.sqlsteps import Steps, frame, lag, lead

from . import microstructure
from .indicators import bollinger_positions, ffd_weights, fit_regimes, intermarket_steps, momentum, notebook_vols, rsi_sma, volume_ratios
from .technical import merged

#: Differenced columns: (order, input).
FFD = {"ffd_close_03": (0.3, "close"), "ffd_close_05": (0.5, "close"), "ffd_volume_04": (0.4, "volume")}
ASSETS = ("market", "rates", "dollar", "vix", "semis", "tech")
NAMES = {"ofi": "order_flow_imbalance"}
REGIMES = 3


def rolling_entropy(r: np.ndarray, k: int = 20, bins: int = 10) -> np.ndarray:
    """Shannon entropy of the last k values in equal bins between the least and the largest of them; NaN where one lacks."""
    out = np.full(len(r), np.nan)
    if len(r) < k:
        return out
    w = np.lib.stride_tricks.sliding_window_view(r, k)
    ok = np.isfinite(w).all(axis=1)
    x = w[ok]
    lo, hi = x.min(axis=1, keepdims=True), x.max(axis=1, keepdims=True)
    edges = lo + np.arange(1, bins) * ((hi - lo) / bins)
    place = (x[:, :, None] >= edges[:, None, :]).sum(axis=2)
    share = (place[:, :, None] == np.arange(bins)).mean(axis=1)
    h = -(share * np.log(np.where(share > 0, share, 1))).sum(axis=1)
    out[np.flatnonzero(ok) + k - 1] = np.where(lo[:, 0] == hi[:, 0], 0.0, h)
    return out


def _recurrent(pdf: pd.DataFrame) -> pd.DataFrame:
    """Columns of one ticker that need its whole past: differences, MACD, entropy, regimes."""
    pdf = pdf.sort_values("date")
    for name, (d, x) in FFD.items():
        series = np.log(pdf[x].to_numpy(float) + (x == "volume"))
        pdf[name] = np.convolve(series, ffd_weights(d))[: len(pdf)]
    mean = lambda s, span: s.ewm(span=span).mean()
    pdf["macd"] = mean(pdf.close, 12) - mean(pdf.close, 26)
    pdf["macd_signal"] = mean(pdf.macd, 9)
    pdf["macd_hist"] = pdf.macd - pdf.macd_signal
    ret = pdf.close.pct_change().to_numpy()
    pdf["return_entropy"] = rolling_entropy(ret)
    regime = np.append(-1, fit_regimes(ret[1:], REGIMES)) if len(pdf) else np.zeros(0, int)
    for k in range(REGIMES):
        pdf[f"regime_{k}"] = (regime == k).astype(float)
    return pdf


def _neutral(k: int = 252, least: int = 20) -> Steps:
    """What a market regression over the k rows before leaves of a return."""
    w = frame(-k, -1)
    ret = {"ret": f"close / {lag('close')} - 1", "mret": f"market / {lag('market')} - 1"}
    fit = {"beta": f"regr_slope(ret, mret) {w}", "alpha": f"regr_intercept(ret, mret) {w}", "known": f"count(ret * mret) {w}", "row": "row_number() OVER (PARTITION BY ticker ORDER BY date) - 1"}
    return Steps([ret, fit, {"neutral_returns": f"CASE WHEN row >= {k} AND known >= {least} THEN ret - (alpha + beta * mret) END"}])


def notebook_table(panel: DataFrame, assets: DataFrame) -> DataFrame:
    """(ticker, date, features, target_1d, target_5d) of every ticker of the panel on the dates that it shares with all of
    the assets; $assets has (asset, date, close) of market, rates, dollar, vix, semis and tech.

    Features but for regimes and targets are z-scored by the ticker's own past up to the row; rows that lack any value are
    left out. The assets' features count those shared dates only, so they too are a ticker's own. All are windows over one
    partitioning by ticker, after one pass in Arrow batches a ticker for what needs its whole past.
    """
    given = ("high", "low", "close", "volume")
    base = panel.select("ticker", "date", *[F.col(c).cast("double") for c in given]).join(_wide(assets), "date").select("ticker", "date", *given, *ASSETS)
    made = [*FFD, "macd", "macd_signal", "macd_hist", "return_entropy", *(f"regime_{k}" for k in range(REGIMES))]
    ddl = "ticker string, date date, " + ", ".join(f"{c} double" for c in (*given, *ASSETS, *made))
    rows = base.groupBy("ticker").applyInPandas(_recurrent, ddl)
    own = merged([momentum(), notebook_vols(), volume_ratios(), bollinger_positions(), rsi_sma(from_first=True), microstructure.flow_pressure(), microstructure.vwap_distance(), _neutral(), intermarket_steps()])
    targets = {"target_1d": f"{lead('close')} / close - 1", "target_5d": f"{lead('close', 5)} / close - 1"}
    rows = own.apply(rows).selectExpr("*", *[f"{e} AS {c}" for c, e in targets.items()])
    columns = [*made, *own.columns]
    rows = rows.select("ticker", "date", *[F.col(c).alias(NAMES.get(c, c)) for c in columns], *targets)
    past = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)

    def scored(c: str):
        x = F.nanvl(F.col(c), F.lit(None))
        return x if c.startswith("regime_") else (x - F.avg(x).over(past)) / (F.stddev_samp(x).over(past) + F.lit(1e-10))

    return rows.select("ticker", "date", *[scored(NAMES.get(c, c)).alias(NAMES.get(c, c)) for c in columns], *targets).dropna()


def _wide(assets: DataFrame) -> DataFrame:
    """A row a date that all assets have, a column an asset."""
    return assets.groupBy("date").agg(*[F.max(F.when(F.col("asset") == a, F.col("close").cast("double"))).alias(a) for a in ASSETS]).dropna()
