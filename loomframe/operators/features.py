"""The whole feature table of a universe: every family of columns in one chain, and filters of long memory."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from loomframe.functions.sqlsteps import Steps, fused

from . import informed, microstructure, technical
from .indicators import ffd_weights


def families() -> dict[str, Steps]:
    """The families in the order in which their columns are taken, by their names; variants of a family have no place here."""
    every = technical.FAMILIES | microstructure.FAMILIES | informed.FAMILIES
    return {name: f() for name, f in every.items() if name != "v07_vol_asymmetry_min5"}


def feature_chain() -> Steps:
    return fused(list(families().values()))


def feature_table(panel: DataFrame, ds: tuple[float, ...] = (0.2, 0.3, 0.4, 0.5), threshold: float = 1e-5, span: int = 63) -> DataFrame:
    """(ticker, date, all features) of a panel (ticker, date, open, high, low, close, volume).

    All windows run behind one exchange by ticker. What is no window runs over the same partitions, a ticker at a time on Arrow
    batches that pass the other columns through: long filters of log prices (null before they are full) and the volatility
    over its exponential mean.
    """
    steps = feature_chain()
    wide = steps.apply(panel.selectExpr("*", "ln(close) AS _log")).selectExpr("ticker", "date", *steps.columns, "rv21 AS _rv", "_log")
    filters = {f"log_price_d{d:g}".replace(".", "_"): np.array(ffd_weights(d, threshold)) for d in ds}

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("date")
        x, rv = group.pop("_log").to_numpy(), group.pop("_rv")
        made = {"vol_surprise": rv - rv.ewm(span=span).mean()}
        for name, w in filters.items():
            made[name] = np.full(len(x), np.nan)
            if len(x) >= len(w):
                made[name][len(w) - 1 :] = np.convolve(x, w, "valid")
        return pd.concat([group, pd.DataFrame(made, group.index)], axis=1)

    kept = [f for f in wide.schema if f.name not in ("_log", "_rv")]
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{n} double" for n in ("vol_surprise", *filters)])
    return wide.groupBy("ticker").applyInPandas(run, ddl)
