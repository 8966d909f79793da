"""Scrapes of HTML tables and lists with built-in string functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = r"(?s)<(?:td|li)[^>]*>(.*?)</(?:td|li)>"
ROW = r"(?s)<tr[^>]*>(.*?)</tr>"
HEAD = r"(?s)<th[^>]*>(.*?)</th>"


def plain(cell: Column) -> Column:
    """Text of a cell: no tags, no [notes], trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(cell, "<[^>]*>", ""), r"\[[^\]]*\]", ""))


def symbol(cell: Column) -> Column:
    """A ticker as prices are keyed by it: class shares with a dash."""
    return F.replace(plain(cell), F.lit("."), F.lit("-"))


def cells(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, cell, symbol) of every table cell and list item."""
    found = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(CELL), 1)).alias("pos", "raw"))
    return found.select(key, "pos", plain(F.col("raw")).alias("cell"), symbol(F.col("raw")).alias("symbol"))


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, href) of every anchor."""
    return pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit('<a href="([^"]*)"'), 1)).alias("pos", "href"))


def constituents(pages: DataFrame, html: str = "html", column: int = 0) -> DataFrame:
    """(ticker) from the first table with id constituents, else the first of class wikitable."""
    pick = lambda p: F.regexp_extract(F.col(html), p, 1)
    own = pick(r'(?s)<table[^>]*id="constituents"[^>]*>(.*?)</table>')
    table = F.when(own != "", own).otherwise(pick(r'(?s)<table[^>]*wikitable[^>]*>(.*?)</table>'))
    rows = pages.select(F.explode(F.regexp_extract_all(table, F.lit(ROW), 1)).alias("row"))
    got = rows.select(symbol(F.get(F.regexp_extract_all("row", F.lit(CELL), 1), F.lit(column))).alias("ticker"))
    return got.where("ticker <> ''").distinct()


def change_log(pages: DataFrame, html: str = "html") -> DataFrame:
    """(date, ticker, action) of tables whose heads name a date and something added or removed: date, added, removed
    are the first three columns; cells that are empty, - or none give no row."""
    table = F.explode(F.regexp_extract_all(F.col(html), F.lit(r"(?s)<table[^>]*>(.*?)</table>"), 1)).alias("t")
    heads = F.lower(F.array_join(F.regexp_extract_all("t", F.lit(HEAD), 1), " "))
    rows = pages.select(table).where(heads.contains("date") & (heads.contains("added") | heads.contains("removed")))
    rows = rows.select(F.explode(F.regexp_extract_all("t", F.lit(ROW), 1)).alias("row")).select(F.regexp_extract_all("row", F.lit(CELL), 1).alias("c"))
    at = lambda i: F.get("c", F.lit(i))
    moves = F.array(F.struct(symbol(at(1)).alias("ticker"), F.lit("add").alias("action")), F.struct(symbol(at(2)).alias("ticker"), F.lit("remove").alias("action")))
    out = rows.select(F.try_to_date(plain(at(0))).alias("date"), F.explode(moves).alias("m")).select("date", "m.*")
    return out.where(F.col("date").isNotNull() & F.col("ticker").isNotNull() & ~F.lower("ticker").isin("", "-", "none"))


CELLS_SQL = r"""
WITH c AS (SELECT page_id, regexp_extract_all(html, '(?s)<(?:td|li)[^>]*>(.*?)</(?:td|li)>', 1) AS xs FROM pages),
e AS (SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, trim(regexp_replace(regexp_replace(xs[i], '<[^>]*>', '', 'g'), '\[[^\]]*\]', '', 'g')) AS cell
  FROM c, range(1, len(xs) + 1) t(i))
SELECT page_id, pos, cell, replace(cell, '.', '-') AS symbol FROM e"""
LINKS_SQL = r"""
WITH c AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS xs FROM pages)
SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, xs[i] AS href FROM c, range(1, len(xs) + 1) t(i)"""
