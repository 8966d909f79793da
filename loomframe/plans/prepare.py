"""Queries of sources, cleaning and universes, with their fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.functions.asof import asof_join
from loomframe.functions.template import Template
from loomframe.operators import clean, universe
from loomframe.sources import bars as src
from loomframe.sources import html
from loomframe.sources.bars import BARS_SQL, bars

from . import oracles

#: Bars with planted errors and repeated days; seq tells the order of arrival.
DIRTY = Template("""
SELECT ticker, date, CASE WHEN day(date) % 17 = 0 THEN NULL ELSE open END AS open, CASE WHEN day(date) % 7 = 0 THEN low ELSE high END AS high,
  CASE WHEN day(date) % 19 = 0 THEN -low ELSE low END AS low,
  CASE WHEN day(date) % 23 = 0 AND month(date) % 2 = 0 THEN close * 1.7 WHEN day(date) % 29 = 0 THEN NULL ELSE close END AS close,
  CASE WHEN day(date) % 13 = 0 THEN NULL ELSE volume END AS volume, 0 AS seq FROM $panel
UNION ALL SELECT ticker, date, open, high, low, close * 1.001, volume, 1 FROM $panel WHERE day(date) % 11 = 0""")

CHANGES = Template("""
SELECT ticker, ADDDAYS(DATE '1995-01-02', CAST(substr(ticker, 7) AS INT) * 20) AS date, CASE WHEN CAST(substr(ticker, 7) AS INT) % 2 = 1 THEN 'add' ELSE 'remove' END AS action
  FROM (SELECT DISTINCT ticker FROM $panel) a WHERE CAST(substr(ticker, 7) AS INT) % 3 > 0
UNION ALL SELECT ticker, ADDDAYS(DATE '1997-01-02', CAST(substr(ticker, 7) AS INT) * 10), CASE WHEN CAST(substr(ticker, 7) AS INT) % 2 = 1 THEN 'remove' ELSE 'add' END
  FROM (SELECT DISTINCT ticker FROM $panel) b WHERE CAST(substr(ticker, 7) AS INT) % 3 > 0""")
CURRENT = Template("SELECT DISTINCT ticker FROM $panel WHERE CAST(substr(ticker, 7) AS INT) % 2 = 0")
MEMBERS = Template("SELECT date, ticker, day(date) % 9 > 0 AS in_universe FROM $panel")
EXTRA = Template("SELECT DISTINCT concat('X', substr(ticker, 7)) AS ticker FROM $panel WHERE substr(ticker, 7, 1) = '1'")

FIXTURES = {"dirty": DIRTY, "changes": CHANGES, "current": CURRENT, "members": MEMBERS, "extra": EXTRA}


def query(t: Template, **inputs: str):
    """inputs: the template's names -> fixtures' names ('panel' is the bars)."""

    def run(spark, sf_dir):
        panel = bars(spark, sf_dir)
        return t.apply(spark, **{k: panel if v == "panel" else FIXTURES[v].apply(spark, panel=panel) for k, v in inputs.items()})

    return run, t.sql(**{k: BARS_SQL if v == "panel" else FIXTURES[v].sql(panel=BARS_SQL) for k, v in inputs.items()})


S, E = "1995-01-02", "1998-12-31"
PAIRS = {
    "c01_clean_ohlcv": query(clean.clean_ohlcv(), panel="dirty"),
    "c02_fix_ohlc": query(clean.fix_ohlc(), panel="dirty"),
    "c03_price_outliers": query(clean.price_outliers(), panel="dirty"),
    "c04_validate": query(clean.validate(), panel="dirty"),
    "c05_forward_fill": query(clean.forward_fill(), panel="dirty"),
    "c06_interpolate": query(clean.interpolate(), panel="dirty"),
    "c07_align_to_calendar": query(clean.align_to_calendar(), panel="panel"),
    "c08_clean_universe": query(Template(f"SELECT ticker, count(*) AS n_rows, min(date) AS first_day, max(date) AS last_day FROM ({clean.clean_ohlcv().text}) c GROUP BY ticker"), panel="dirty"),
    "c09_returns": query(clean.returns(), panel="panel"),
    "c10_forward_returns": query(clean.forward_returns(), panel="panel"),
    "c11_build_panel": query(clean.build_panel(S, E), panel="panel"),
    "c14_market_check": query(clean.market_check(), panel="dirty"),
    "c16_drop_incomplete": query(clean.drop_incomplete(), panel="dirty"),
    "c17_fill_zero": query(clean.fill_zero(), panel="dirty"),
    "u01_reconstruct": query(universe.reconstruct(S, E), changes="changes", current="current"),
    "u02_business_days": query(universe.business_days_of(), panel="panel"),
    "u03_full_universe": query(universe.full_universe("1995-01-02", "1995-12-29"), members="members", extra="extra"),
    "u04_on_date": query(universe.on_date("1996-05-06"), members="members"),
    "u04_date_range": query(universe.date_range(S, E), members="members"),
    "u05_liquidity_filter": query(universe.liquidity_filter(min_dollars=30_000), panel="panel", members="members"),
    "u06_latest": query(universe.latest(), members="members"),
    "u07_nearest_date": query(universe.nearest_date("1996-05-05"), panel="panel"),
    "u08_adv_snapshot": query(universe.adv_snapshot(), panel="panel"),
    "u09_period_tickers": query(universe.period_tickers(S, E), members="members"),
}
QUERIES = {k: v[0] for k, v in PAIRS.items()}
ORACLES = {k: v[1] for k, v in PAIRS.items()} | oracles.cleaning(DIRTY.sql(panel=BARS_SQL)) | oracles.cleaned(DIRTY.sql(panel=BARS_SQL))
ORACLES |= oracles.universes(*[FIXTURES[f].sql(panel=BARS_SQL) for f in ("changes", "current", "members", "extra")])

WIDE = [f"Brand#{i}" for i in range(1, 26)]


def _wide(spark, sf_dir):
    wide = clean.pivot_wide(bars(spark, sf_dir), "close", WIDE)
    return wide.select("date", *[F.round(F.col(f"`{t}`"), 6).alias(t.lower().replace("#", "_")) for t in WIDE])


def _unpivot(spark, sf_dir):
    return clean.unpivot_long(clean.pivot_wide(bars(spark, sf_dir), "close", WIDE), "close").withColumn("close", F.round("close", 6))


def _renamed(spark, sf_dir):
    return clean.select_columns(bars(spark, sf_dir).select("ticker", "date", "close", "volume"), "eq")


def _asked(spark, sf_dir):
    """Odd days of the panel, two days later each, and what it knows of its days that 4 divides."""
    panel = bars(spark, sf_dir)
    asked = panel.where("day(date) % 2 = 1").select("ticker", F.date_add("date", 2).alias("date"))
    return asked, panel.where("day(date) % 4 = 0").select("ticker", "date", F.col("date").alias("known"), F.round("close", 6).alias("close"))


def _asof(forward: bool):
    def run(spark, sf_dir):
        asked, known = _asked(spark, sf_dir)
        return asof_join(asked, known, ["ticker"], "date", ["known", "close"], 5 * 86_400, forward=forward)

    return run


def _asof_events(spark, sf_dir):
    """Each purchase or signup with the last view before it, whoever viewed, at most an hour earlier: one key for all rows."""
    events = src.read_table(spark, sf_dir, "events").withColumn("every", F.lit(1))
    later = events.where("event_type IN ('purchase', 'signup')").select("event_id", "ts", "every")
    views = events.where("event_type = 'view'").select("every", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("viewed"))
    return asof_join(later, views, ["every"], "ts", ["view_id", "viewed"], 3600, width=86_400, strict=True).select("event_id", "view_id", "viewed")


def _upsert(spark, sf_dir):
    panel = bars(spark, sf_dir)
    fresh = panel.where("year(date) = 1996").withColumn("close", F.col("close") * 2)
    out = src.upsert(panel.where("date < '1996-07-01'"), fresh)
    return out.select("ticker", "date", F.round("close", 6).alias("close"), "volume")


def _assets(spark, sf_dir):
    """Named assets of the panel by a dimension table: name, ticker."""
    names = spark.createDataFrame([("market", "Brand#11"), ("tech", "Brand#22"), ("rates", "Brand#33")], "asset string, ticker string")
    return bars(spark, sf_dir).join(F.broadcast(names), "ticker").select("asset", "date", F.round("close", 6).alias("close"))


ROLES = {"market": "Brand#11", "tech": "Brand#22", "rates": "Brand#3"}


def _wide_assets(spark, sf_dir):
    wide = src.wide_assets(bars(spark, sf_dir), ROLES, ["close", "volume"])
    return wide.select("date", *[F.round(c, 6).alias(c) for c in wide.columns if c != "date"])


def _constituents(spark, sf_dir):
    """The panel's tickers written as a table of constituents, behind another table, and scraped back."""
    names = src.tickers(bars(spark, sf_dir)).select(F.replace("ticker", F.lit("#"), F.lit(".")).alias("t"))
    row = F.concat(F.lit("<tr><td><a href=x>"), "t", F.lit("</a>[1]</td><td>other</td></tr>"))
    page = names.agg(F.array_join(F.sort_array(F.collect_list(row)), "").alias("rows"))  # a page: as many rows as tickers
    html_ = F.concat(F.lit('<table class="wikitable"><tr><td>no</td></tr></table><table id="constituents"><tr><th>Symbol</th></tr>'), "rows", F.lit("</table>"))
    return html.constituents(page.select(html_.alias("html")))


def _change_log(spark, sf_dir):
    """The change log written as an HTML table and scraped back."""
    rows = CHANGES.apply(spark, panel=bars(spark, sf_dir))
    cell = lambda a: F.when(F.col("action") == a, F.concat(F.replace("ticker", F.lit("Brand#"), F.lit("B.")), F.lit("[1]"))).otherwise("-")
    row = F.concat(F.lit("<tr><td>"), F.col("date").cast("string"), F.lit("</td><td><a>"), cell("add"), F.lit("</a></td><td>"), cell("remove"), F.lit("</td></tr>"))
    pages = rows.select(F.concat(F.lit("<table><tr><th>Date</th><th>Added</th><th>Removed</th></tr>"), row, F.lit("</table>")).alias("html"))
    return html.change_log(pages)


QUERIES |= {
    "u07_asof_before": _asof(False),
    "u07_asof_after": _asof(True),
    "st_asof_events": _asof_events,
    "c12_pivot_wide": _wide,
    "c12_unpivot": _unpivot,
    "c13_select_columns": _renamed,
    "s01_scan_bars": lambda spark, sf_dir: bars(spark, sf_dir).select("ticker", "date", *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close", "volume")]),
    "s01_bars_from_trades": lambda spark, sf_dir: src.derived_bars(spark, sf_dir).select("ticker", "date", *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close", "volume")]),
    "s08_tickers": lambda spark, sf_dir: src.tickers(bars(spark, sf_dir)),
    "s09_upsert": _upsert,
    "s10_html_cells": lambda spark, sf_dir: html.cells(src.read_table(spark, sf_dir, "pages")),
    "s10_html_links": lambda spark, sf_dir: html.links(src.read_table(spark, sf_dir, "pages")),
    "s11_change_log": _change_log,
    "s10_constituents": _constituents,
    "s16_named_assets": _assets,
    "s16_wide_assets": _wide_assets,
}
ORACLES |= {
    "u02_business_days": f"""SELECT DISTINCT d.date FROM (SELECT unnest(generate_series(DATE '1980-01-01', DATE '2060-12-31', INTERVAL 1 DAY))::DATE AS date) d
WHERE d.date >= (SELECT min(date) FROM ({BARS_SQL})) AND d.date <= (SELECT max(date) FROM ({BARS_SQL})) AND dayname(d.date) NOT IN ('Saturday', 'Sunday')""",
    "u07_asof_before": oracles.asof(">="),
    "u07_asof_after": oracles.asof("<="),
    "st_asof_events": """SELECT e.event_id, CASE WHEN e.ts - v.ts <= INTERVAL 1 HOUR THEN v.event_id END AS view_id, CASE WHEN e.ts - v.ts <= INTERVAL 1 HOUR THEN v.value END AS viewed
FROM (SELECT * FROM events WHERE event_type IN ('purchase', 'signup')) e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON e.ts > v.ts""",
    "c12_pivot_wide": "SELECT date, " + ", ".join(f"round(max(close) FILTER (ticker = '{t}'), 6) AS {t.lower().replace('#', '_')}" for t in WIDE) + f" FROM ({BARS_SQL}) GROUP BY date",
    "c12_unpivot": f"SELECT date, ticker, round(close, 6) AS close FROM ({BARS_SQL}) WHERE close IS NOT NULL",
    "c13_select_columns": f"SELECT ticker, date, close AS eq_close, volume AS eq_volume FROM ({BARS_SQL})",
    "s01_scan_bars": f"SELECT ticker, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM ({BARS_SQL})",
    "s01_bars_from_trades": f"SELECT ticker, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM ({BARS_SQL})",
    "s08_tickers": f"SELECT DISTINCT ticker FROM ({BARS_SQL})",
    "s09_upsert": f"""WITH p AS ({BARS_SQL}) SELECT ticker, date, round(CASE WHEN year(date) = 1996 THEN close * 2 ELSE close END, 6) AS close, volume
FROM p WHERE date < DATE '1996-07-01' OR year(date) = 1996""",
    "s16_named_assets": f"""SELECT asset, date, round(close, 6) AS close FROM ({BARS_SQL}) JOIN (VALUES ('market', 'Brand#11'), ('tech', 'Brand#22'), ('rates', 'Brand#33')) n(asset, ticker) USING (ticker)""",
    "s11_change_log": f"SELECT date, replace(ticker, 'Brand#', 'B-') AS ticker, action FROM ({CHANGES.sql(panel=BARS_SQL)})",
    "s10_constituents": f"SELECT DISTINCT replace(ticker, '#', '-') AS ticker FROM ({BARS_SQL})",
    "s16_wide_assets": "SELECT date, " + ", ".join(f"round({a}.{c}, 6) AS {a}_{c}" for a in ROLES for c in ("close", "volume")) + " FROM "
    + " JOIN ".join(f"(SELECT * FROM ({BARS_SQL}) WHERE ticker = '{t}') {a}" + (" USING (date)" if i else "") for i, (a, t) in enumerate(ROLES.items())),
    "s10_html_cells": html.CELLS_SQL,
    "s10_html_links": html.LINKS_SQL,
}
