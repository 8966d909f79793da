"""Queries of indicators, cross-sections, labels, splits, metrics and backtests, with their fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataclasses import replace

from loomframe.functions.shared import stored
from loomframe.functions.sqlsteps import lag, last, lead, rolling
from loomframe.functions.template import Template
from loomframe.operators import backtest, features, indicators, informed, labeling, metrics, notebook, splits, technical, xsection
from loomframe.sources.bars import BARS_SQL, bars, bucketed_bars

from . import oracles, panel

SCORED = Template(f"""
WITH r AS (SELECT ticker, date, close, volume, close / {lag('close')} - 1 AS ret FROM $panel)
SELECT ticker, date, close, volume, ret, round(-({rolling('sum', 'ret', 5)}), 7) AS signal, round({lead('close')} / close - 1, 8) AS fwd,
  round({lead('close')} / close - 1, 8) AS fwd_1, round({lead('close', 5)} / close - 1, 8) AS fwd_5, round({lead('close', 10)} / close - 1, 8) AS fwd_10, round({lead('close', 21)} / close - 1, 8) AS fwd_21,
  1000 * ({rolling('avg', 'close * volume', 21)}) AS adv, {rolling('stddev_samp', 'ret', 21)} AS vol, CAST(substr(ticker, 7) AS INT) % 5 AS sector FROM r""")
PROBS = Template("SELECT ticker, date, (day(date) % 10) / 10e0 AS p1, (day(date) % 7) / 7e0 AS p2 FROM $panel")
DAILY = Template(f"SELECT date, avg(ret) AS ret FROM (SELECT date, close / {lag('close')} - 1 AS ret FROM $panel) r WHERE ret IS NOT NULL GROUP BY date")
#: Averages of six groups of names, so that nearly every date has them all.
BASKETS = Template("""SELECT CASE CAST(substr(ticker, 7) AS INT) % 6 WHEN 0 THEN 'market' WHEN 1 THEN 'rates' WHEN 2 THEN 'dollar' WHEN 3 THEN 'vix' WHEN 4 THEN 'semis' ELSE 'tech' END AS asset,
  date, avg(close) AS close FROM $panel GROUP BY 1, 2""")
HARD = Template("SELECT DISTINCT ticker FROM $panel WHERE CAST(substr(ticker, 7) AS INT) % 7 = 0")
YEARS = Template("SELECT year(date) - 1992 AS split_id, min(date) AS lo, max(date) AS hi FROM $panel GROUP BY year(date)")
SPLITS = splits.walk_forward("1993-01-01", "1994-12-30", "1998-12-31")
FLOW = technical.merged([replace(informed.vpin(), digits={}), replace(informed.csi((21,)), digits={})])
FLOWS = Template(f"SELECT ticker, date, round(vpin_b1, 9) AS vpin, round(csi_21d, 9) AS vol FROM ({FLOW.sql('SELECT * FROM $panel')}) x")


FIXTURES = {
    "scored": SCORED, "multi": SCORED, "trades": Template(f"SELECT * FROM ({SCORED.text}) t WHERE adv IS NOT NULL AND vol IS NOT NULL"), "probs": PROBS, "daily": DAILY,
    "orders": Template("SELECT ticker, (CASE WHEN day(date) % 2 = 0 THEN 1 ELSE -1 END) * close * volume AS trade_value FROM $panel WHERE date = DATE '1996-05-06'"),
    "volumes": Template("SELECT ticker, avg(close * volume) AS adv FROM $panel WHERE CAST(substr(ticker, 7) AS INT) % 5 > 0 GROUP BY ticker"),
    "assets": Template(f"SELECT asset, date, round(close / 7, 9) AS close FROM ({BASKETS.text}) b"), "hard": HARD, "years": YEARS, "flows": FLOWS, "splits": SPLITS,
    "events": labeling.barrier_events(), "batch": labeling.barrier_events(batch=True),
}


def _weights_frame(spark, panel):
    scored = SCORED.apply(spark, panel=panel)
    return backtest.final_weights().apply(spark, scored=scored).where("weight IS NOT NULL")


WEIGHTS_SQL = f"SELECT * FROM ({backtest.final_weights().sql(scored=SCORED.sql(panel=BARS_SQL))}) WHERE weight IS NOT NULL"


def query(t: Template, **inputs: str):
    def run(spark, sf_dir):
        panel = bars(spark, sf_dir)

        def frame(v: str):
            return panel if v == "panel" else _weights_frame(spark, panel) if v == "weights" else FIXTURES[v].apply(spark, panel=panel)

        return t.apply(spark, **{k: frame(v) for k, v in inputs.items()})

    return run, t.sql(**{k: BARS_SQL if v == "panel" else WEIGHTS_SQL if v == "weights" else FIXTURES[v].sql(panel=BARS_SQL) for k, v in inputs.items()})


def steps(s):
    return (lambda spark, sf_dir: s.result(bars(spark, sf_dir))), s.sql(BARS_SQL)


VALID = indicators.fracdiff((0.5,))
S, E = "1995-01-02", "1998-12-31"
PAIRS = {
    "f02_fracdiff": steps(indicators.fracdiff((0.5,))),
    "f03_fracdiff_multi": steps(indicators.fracdiff((0.4, 0.5, 0.6))),
    "f05_fracdiff_valid": steps(type(VALID)(VALID.levels, VALID.out, digits=VALID.digits, where="log_price_d0_5 IS NOT NULL")),
    "f07_fracdiff_padded": steps(indicators.fracdiff((0.5,), padded=True)),
    "i01_rsi_sma": steps(indicators.rsi_sma()),
    "i04_bollinger": steps(indicators.bollinger()),
    "i05_rolling_stats": steps(indicators.rolling_stats()),
    "i04_bollinger_positions": steps(indicators.bollinger_positions()),
    "i07_momentum": steps(indicators.momentum()),
    "i08_volume_ratios": steps(indicators.volume_ratios()),
    "i09_notebook_vols": steps(indicators.notebook_vols()),
    "i10_market_neutral": query(indicators.market_neutral(), panel="panel"),
    "i12_intermarket": query(indicators.intermarket(), assets="assets"),
    "i13_expanding_zscore": steps(indicators.expanding_zscore()),
    "v11_informed_signal": query(indicators.quantile_signal(), panel="flows"),
    "x01_normalise": query(xsection.normalise(["signal", "volume"]), panel="scored"),
    "x02_normalise_wide": query(xsection.normalise(["signal", "volume"], undivided=True), panel="scored"),
    "x03_percent_rank": query(xsection.ranks(), panel="scored"),
    "x04_deciles": query(xsection.deciles(), panel="scored"),
    "x05_quantile_buckets": query(Template(xsection.quantile_buckets()), panel="scored"),
    "x06_date_slice": query(xsection.date_slice("1996-05-06", ["signal", "volume"]), panel="scored"),
    "x07_cube": query(xsection.cube("1996-01-01", "1996-06-30", ["close", "volume"]), panel="panel"),
    "x10_sector_exposure": query(xsection.sector_exposure(), weights="weights"),
    "x11_factor_exposure": query(xsection.factor_exposure(["signal", "volume"]), weights="weights", panel="scored"),
    "x12_concentration": query(xsection.concentration(), weights="weights"),
    "l01_daily_vol": query(labeling.daily_vol(), panel="panel"),
    "l02_l03_barrier_events": query(labeling.barrier_events(), panel="panel"),
    "l04_l06_batch_events": query(labeling.barrier_events(batch=True), panel="panel"),
    "l05_uniqueness_weights": query(labeling.uniqueness_weights(), events="events", panel="panel"),
    "l07_stage_one": query(labeling.stage_one(), events="events"),
    "l08_stage_two": query(labeling.stage_two(), events="events", probs="probs"),
    "l09_meta_labels": query(labeling.meta_labels(), events="events", probs="probs"),
    "l10_training_set": query(labeling.training_set(["signal", "volume"]), events="events", panel="scored"),
    "l11_bet_size": query(labeling.bet_size(), probs="probs"),
    "l12_purged_split": query(labeling.purged_split("1996-06-28", "1996-07-01"), events="events"),
    "l13_quality_report": query(labeling.quality_report(), events="events"),
    "l14_look_ahead": query(labeling.look_ahead_check(), events="events", panel="panel"),
    "p01_walk_forward": query(splits.walk_forward_over(), panel="panel"),
    "p02_assign": query(splits.assign(), panel="panel", splits="splits"),
    "p03_summary": query(splits.summary(), panel="panel", splits="splits"),
    "p04_purged_kfold": query(splits.purged_kfold(), panel="panel"),
    "p05_temporal": query(splits.temporal(), panel="panel"),
    "p06_combinatorial": query(splits.combinatorial(), panel="panel"),
    "p06_roles": query(splits.roles(), panel="panel"),
    "p07_holdout_80_20": query(splits.holdout({"train": 0.8, "test": 0.2}), panel="panel"),
    "p07_holdout_70_15_15": query(splits.holdout({"train": 0.7, "val": 0.15, "test": 0.15}), panel="panel"),
    "k01_ic": query(metrics.pooled_ic(), scored="scored"),
    "k01_ic_pearson": query(metrics.pooled_ic(spearman=False), scored="scored"),
    "k02_daily_ic": query(metrics.daily_ic(), scored="scored"),
    "k03_icir": query(metrics.icir(), scored="scored"),
    "k04_sharpe": query(metrics.sharpe_ratio(), daily="daily"),
    "k05_max_drawdown": query(metrics.max_drawdown(), daily="daily"),
    "k06_turnover": query(metrics.turnover(), weights="weights"),
    "k08_ic_decay": query(metrics.ic_decay(), multi="multi"),
    "k09_quantile_returns": query(metrics.quantile_returns(), panel="scored"),
    "k10_sector_ic": query(metrics.sector_ic(), scored="scored"),
    "k11_rolling_metrics": query(metrics.rolling_metrics(), daily="daily"),
    "k12_sharpe_variants": query(metrics.sharpe_variants(), daily="daily"),
    "k13_max_drawdown_from_one": query(metrics.max_drawdown(from_one=True), daily="daily"),
    "k14_ordinal_ic": query(metrics.ordinal_ic(), scored="scored"),
    "k15_strategy_return": query(metrics.strategy_return(), scored="scored"),
    "k16_ic_monitor": query(metrics.ic_monitor(), scored="scored"),
    "b01_align": query(backtest.align(), scored="scored"),
    "b02_target_weights": query(backtest.target_weights(), scored="scored"),
    "b03_capped_weights": query(backtest.capped_weights(), scored="scored"),
    "b04_neutral_weights": query(backtest.neutral_weights(), scored="scored"),
    "b05_final_weights": query(backtest.final_weights(), scored="scored"),
    "b06_gross_returns": query(backtest.gross_returns(), scored="scored"),
    "b07_trading_costs": query(backtest.trading_costs(), scored="scored"),
    "b08_impact_costs": query(backtest.impact_costs(), scored="scored"),
    "b09_positions": query(backtest.positions(), scored="scored"),
    "b11_transaction_costs": query(backtest.transaction_costs(), trades="trades"),
    "b11_portfolio_costs": query(backtest.portfolio_costs(), trades="orders", volumes="volumes"),
    "b12_market_impact": query(backtest.market_impact(), trades="trades"),
    "b13_twap": query(backtest.twap(5), trades="trades"),
    "b14_slippage": query(backtest.slippage(), trades="trades"),
    "b15_borrow_costs": query(backtest.borrow_costs(), weights="weights", hard="hard"),
}
QUERIES = {k: v[0] for k, v in PAIRS.items()}
ORACLES = {k: v[1] for k, v in PAIRS.items()}



def _scored(spark, sf_dir):
    return SCORED.apply(spark, panel=bars(spark, sf_dir))


def _summary(spark, sf_dir):
    """The scored panel is stored, since its signals and the weights made of them are both summed up."""
    panel = bars(spark, sf_dir)
    scored = stored(SCORED.apply(spark, panel=panel), "scored")
    weights = backtest.final_weights().apply(spark, scored=scored).where("weight IS NOT NULL")
    return metrics.with_p_value(metrics.summary().apply(spark, scored=scored, daily=DAILY.apply(spark, panel=panel), weights=weights))


def _walk_forward(spark, sf_dir):
    panel = bars(spark, sf_dir)
    return backtest.walk_forward().apply(spark, scored=SCORED.apply(spark, panel=panel), splits=YEARS.apply(spark, panel=panel))


QUERIES |= {
    "k07_summary": _summary,
    "k17_acceptance_gate": lambda spark, sf_dir: metrics.acceptance_gate().apply(spark, run=backtest.result().apply(spark, scored=_scored(spark, sf_dir))),
    "b09_result": lambda spark, sf_dir: backtest.result().apply(spark, scored=_scored(spark, sf_dir)),
    "b10_walk_forward": _walk_forward,
    "p07_evaluate": lambda spark, sf_dir: splits.evaluate(_scored(spark, sf_dir)),
    "k01_ic_whole": lambda spark, sf_dir: metrics.whole_ic(_scored(spark, sf_dir)),
    "l01_ewm_vol": lambda spark, sf_dir: labeling.ewm_vol(bars(spark, sf_dir)).select("ticker", "date", F.round("vol", 7).alias("vol")),
    "e01_ewm": lambda spark, sf_dir: indicators.ewm(bars(spark, sf_dir)),
    "v10_vol_surprise": lambda spark, sf_dir: indicators.vol_surprise(bars(spark, sf_dir)),
    "e02_ema": lambda spark, sf_dir: indicators.ema(bars(spark, sf_dir)),
    "i02_rsi_wilder": lambda spark, sf_dir: indicators.rsi_wilder(bars(spark, sf_dir)),
    "i03_macd": lambda spark, sf_dir: indicators.macd(bars(spark, sf_dir)),
    "i06_entropy": lambda spark, sf_dir: indicators.entropy(bars(spark, sf_dir)),
    "i06_entropy_known": lambda spark, sf_dir: indicators.entropy(bars(spark, sf_dir).withColumn("close", F.expr("CASE WHEN day(date) % 7 > 0 THEN close END")), least=5),
    "x08_last_sequence": lambda spark, sf_dir: xsection.steps_of(xsection.last_sequences(bars(spark, sf_dir), "1996-05-06", 10, ["close", "volume"]), ["close", "volume"]),
    "x09_supervised": lambda spark, sf_dir: xsection.steps_of(xsection.supervised(SCORED.apply(spark, panel=bars(spark, sf_dir)), 10, ["close", "volume", "signal"], "fwd"), ["close", "volume", "signal"]),
    "i11_hmm_regimes": lambda spark, sf_dir: indicators.hmm_regimes(bars(spark, sf_dir)),
    "s02_bucketed_technical": lambda spark, sf_dir: technical.compute_all().result(bucketed_bars(spark, sf_dir)),
    "s02_bucketed_training_set": lambda spark, sf_dir: _bucketed_training(spark, sf_dir),
    "g03_feature_table": lambda spark, sf_dir: _features(spark, sf_dir),
    "i14_notebook_features": lambda spark, sf_dir: _notebook(spark, sf_dir),
    "f02_fracdiff_long": lambda spark, sf_dir: indicators.fracdiff_long(bars(spark, sf_dir)).select("ticker", "date", *[F.round(c, 6).alias(c) for c in ("d0_2", "d0_5")]),
    "f03_fracdiff_multi_long": lambda spark, sf_dir: indicators.fracdiff_long(bars(spark, sf_dir), (0.4, 0.5, 0.6)).select("ticker", "date", *[F.round(c, 6).alias(c) for c in ("d0_4", "d0_5", "d0_6")]),
    "f05_fracdiff_valid_long": lambda spark, sf_dir: indicators.fracdiff_long(bars(spark, sf_dir), (0.5,)).where("d0_5 IS NOT NULL").select("ticker", "date", F.round("d0_5", 6).alias("d0_5")),
    "f07_fracdiff_padded_long": lambda spark, sf_dir: indicators.fracdiff_long(bars(spark, sf_dir), (0.5,), padded=True).select("ticker", "date", F.round("d0_5", 6).alias("d0_5")),
    "f04_min_d": lambda spark, sf_dir: indicators.find_min_d(bars(spark, sf_dir)),
}



def _notebook(spark, sf_dir):
    panel = bars(spark, sf_dir)
    table = notebook.notebook_table(panel, BASKETS.apply(spark, panel=panel))
    return table.select("ticker", "date", *[(F.round(c, 4) + 0.0).alias(c) for c in table.columns if c not in ("ticker", "date")])


def _bucketed_training(spark, sf_dir):
    panel = bucketed_bars(spark, sf_dir)
    own = panel.sparkSession
    return labeling.training_set(["signal", "volume"]).apply(own, events=labeling.barrier_events().apply(own, panel=panel), panel=SCORED.apply(own, panel=panel))


def _features(spark, sf_dir):
    """Every column of the feature table, rounded as in the families' own queries."""
    table, digits = features.feature_table(bars(spark, sf_dir)), features.feature_chain().digits
    short = {"vol_surprise": 6} | {c: 6 for c in table.columns if c.startswith("log_price")}
    return table.select("ticker", "date", *[F.expr(f"round({c}, {(digits | short)[c]}) + 0.0 AS {c}") if c in digits | short else F.col(c) for c in table.columns[2:]])


RUN = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _ewm_sql(x: str, span: int, adjust: bool) -> str:
    """Exponential mean as running sums scaled by powers of the decay (i: 0-based row of the ticker)."""
    keep = 1 - 2 / (span + 1)
    if adjust:
        return f"sum({x} * power({keep!r}e0, -i)) {RUN} / sum(power({keep!r}e0, -i)) {RUN}"
    return f"power({keep!r}e0, i) * sum({x} * power({keep!r}e0, -i) * CASE WHEN i = 0 THEN 1 ELSE {1 - keep!r}e0 END) {RUN}"


NUMBERED = f"n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i FROM ({BARS_SQL}) b)"
_macd = []
for adjust, tail in ((True, "_adj"), (False, "")):
    _macd.append(f"{_ewm_sql('close', 12, adjust)} - {_ewm_sql('close', 26, adjust)} AS line{tail}")
ORACLES |= {
    "v10_vol_surprise": f"""WITH {NUMBERED}, l AS (SELECT ticker, date, i, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS r FROM n),
v AS (SELECT ticker, date, i, CASE WHEN count(r) {last(21)} = 21 THEN stddev_samp(r) {last(21)} * sqrt(252) END AS rv FROM l),
w AS (SELECT *, CASE WHEN rv IS NOT NULL THEN power({1 - 2 / 64!r}e0, -i) END AS k FROM v)
SELECT ticker, date, round(rv - sum(rv * k) {RUN} / sum(k) {RUN}, 6) + 0.0 AS vol_surprise FROM w""",
    "e01_ewm": f"WITH {NUMBERED} SELECT ticker, date, round({_ewm_sql('close', 63, True)}, 5) AS ewm_63 FROM n",
    "e02_ema": f"WITH {NUMBERED} SELECT ticker, date, round({_ewm_sql('close', 20, False)}, 5) AS ema_20 FROM n",
    "i03_macd": f"""WITH {NUMBERED}, m AS (SELECT ticker, date, i, {', '.join(_macd)} FROM n),
s AS (SELECT *, {_ewm_sql('line_adj', 9, True)} AS sig_adj, {_ewm_sql('line', 9, False)} AS sig FROM m)
SELECT ticker, date, round(line_adj, 5) AS macd_adj, round(sig_adj, 5) AS macd_signal_adj, round(line_adj - sig_adj, 5) AS macd_hist_adj,
  round(line, 5) AS macd, round(sig, 5) AS macd_signal, round(line - sig, 5) AS macd_hist FROM s""",
    "i02_rsi_wilder": f"""WITH {NUMBERED}, d AS (SELECT *, close - lag(close) OVER (PARTITION BY ticker ORDER BY date) AS dc FROM n),
g AS (SELECT *, CASE WHEN i BETWEEN 1 AND 14 THEN greatest(dc, 0) / 14 WHEN i > 14 THEN greatest(dc, 0) / 14 * power(13 / 14e0, 14 - i) END AS u,
  CASE WHEN i BETWEEN 1 AND 14 THEN greatest(-dc, 0) / 14 WHEN i > 14 THEN greatest(-dc, 0) / 14 * power(13 / 14e0, 14 - i) END AS l FROM d),
a AS (SELECT *, sum(u) {RUN} * power(13 / 14e0, i - 14) AS au, sum(l) {RUN} * power(13 / 14e0, i - 14) AS al FROM g)
SELECT ticker, date, round(CASE WHEN i < 14 THEN NULL WHEN al = 0 THEN 100 ELSE 100 - 100 / (1 + au / al) END, 5) AS rsi_14 FROM a""",
    "i06_entropy": f"""WITH {NUMBERED}, r AS (SELECT ticker, date, i, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM n),
w AS (SELECT *, count(r) {last(20)} AS c, min(r) {last(20)} AS lo, max(r) {last(20)} AS hi FROM r),
p AS (SELECT a.ticker, a.date, len(list_filter([1, 2, 3, 4, 5, 6, 7, 8, 9], lambda q: a.lo + q * ((a.hi - a.lo) / 10) <= b.r)) AS bin
  FROM w a JOIN r b ON a.ticker = b.ticker AND b.i BETWEEN a.i - 19 AND a.i WHERE a.c = 20),
c AS (SELECT ticker, date, bin, count(*) / 20e0 AS p FROM p GROUP BY ALL), h AS (SELECT ticker, date, -sum(p * ln(p)) AS h FROM c GROUP BY ALL)
SELECT w.ticker, w.date, round(CASE WHEN w.c < 20 THEN NULL WHEN w.lo = w.hi THEN 0 ELSE h END, 6) + 0.0 AS entropy FROM w LEFT JOIN h ON w.ticker = h.ticker AND w.date = h.date""",
    "i06_entropy_known": f"""WITH {NUMBERED}, r AS (SELECT ticker, date, i, x / lag(x) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM (SELECT *, CASE WHEN day(date) % 7 > 0 THEN close END AS x FROM n)),
w AS (SELECT *, count(r) {last(20)} AS c, min(r) {last(20)} AS lo, max(r) {last(20)} AS hi FROM r),
p AS (SELECT a.ticker, a.date, len(list_filter([1, 2, 3, 4, 5, 6, 7, 8, 9], lambda q: a.lo + q * ((a.hi - a.lo) / 10) <= b.r)) AS bin
  FROM w a JOIN r b ON a.ticker = b.ticker AND b.i BETWEEN a.i - 19 AND a.i WHERE a.c >= 5 AND a.i >= 19 AND b.r IS NOT NULL),
c AS (SELECT ticker, date, bin, n / sum(n) OVER (PARTITION BY ticker, date) AS p FROM (SELECT ticker, date, bin, count(*)::DOUBLE AS n FROM p GROUP BY ticker, date, bin) k), h AS (SELECT ticker, date, -sum(p * ln(p)) AS h FROM c GROUP BY ALL)
SELECT w.ticker, w.date, round(CASE WHEN w.c < 5 OR w.i < 19 THEN NULL WHEN w.lo = w.hi THEN 0 ELSE h END, 6) + 0.0 AS entropy FROM w LEFT JOIN h ON w.ticker = h.ticker AND w.date = h.date""",
}
ORACLES |= oracles.INDICATORS
ORACLES |= oracles.backtests(SCORED.sql(panel=BARS_SQL), YEARS.sql(panel=BARS_SQL), FIXTURES["trades"].sql(panel=BARS_SQL))
ORACLES |= oracles.metrics(SCORED.sql(panel=BARS_SQL), DAILY.sql(panel=BARS_SQL), WEIGHTS_SQL)
ORACLES |= oracles.pooled(SCORED.sql(panel=BARS_SQL))
ORACLES |= oracles.sequences(SCORED.sql(panel=BARS_SQL))
ORACLES["l01_ewm_vol"] = oracles.ewm_deviation()
ORACLES["g03_feature_table"] = oracles.feature_table({n: s.columns for n, s in features.families().items()}, panel.ORACLES, ORACLES["v10_vol_surprise"])
ORACLES["p01_walk_forward"] = oracles.walk_forward()
ORACLES |= oracles.cross_sections(SCORED.sql(panel=BARS_SQL), WEIGHTS_SQL)
ORACLES |= oracles.labels(SCORED.sql(panel=BARS_SQL), PROBS.sql(panel=BARS_SQL)) | oracles.signal_metrics(SCORED.sql(panel=BARS_SQL), DAILY.sql(panel=BARS_SQL))
ORACLES |= {"s02_bucketed_technical": oracles.TECHNICAL["t20_all"], "s02_bucketed_training_set": ORACLES["l10_training_set"]}
ORACLES |= oracles.splits(SPLITS.sql())
ORACLES |= oracles.indicators() | oracles.long_filters()
ORACLES |= oracles.trades(SCORED.sql(panel=BARS_SQL), FIXTURES["trades"].sql(panel=BARS_SQL), WEIGHTS_SQL, HARD.sql(panel=BARS_SQL))
ORACLES["i10_market_neutral"] = oracles.flow()["i10_market_neutral"]
ORACLES["b11_portfolio_costs"] = oracles.portfolio(FIXTURES["orders"].sql(panel=BARS_SQL), FIXTURES["volumes"].sql(panel=BARS_SQL))
