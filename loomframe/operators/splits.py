"""Leak-free validation splits as tables: purged walk-forward, k-fold, temporal and combinatorial."""

from __future__ import annotations

from datetime import date
from itertools import combinations

from pyspark.sql import DataFrame

from loomframe.functions.ordered import average_ranks
from loomframe.functions.shared import stored
from loomframe.functions.template import Template

from .clean import CALENDAR
from .metrics import YEAR


def walk_forward(start: str, first_end: str, final_end: str, purge: int = 63, val: int = 252, test: int = 252, roll: int = 252) -> Template:
    """(split_id, train_start, train_end, purge_end, val_start, val_end, test_start, test_end) on business days.

    All dates are positions of one calendar, so the splits are arithmetic on its index; the last test is cut at the
    calendar's end.
    """
    cal = CALENDAR.format(a=f"DATE '{start}'", b=f"DATE '{final_end}'", src="(SELECT 1 AS one) o")
    most = (date.fromisoformat(final_end) - date.fromisoformat(first_end)).days // roll + 1  # calendar days: never too few
    names = {"train_end": "te", "purge_end": f"te + {purge}", "val_start": f"te + {purge + 1}", "val_end": f"te + {purge + 1 + val}",
             "test_start": f"te + {purge + 2 + val}", "test_end": f"least(te + {purge + 2 + val + test}, n)"}
    joins = " ".join(f"JOIN cal {c} ON {c}.i = {e}" for c, e in names.items())
    return Template(f"""
WITH cal AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM ({cal}) c),
z AS (SELECT max(i) AS n, max(CASE WHEN date <= DATE '{first_end}' THEN i END) AS t0, min(date) AS train_start FROM cal),
s AS (SELECT split_id, train_start, n, t0 + {roll} * split_id AS te FROM z CROSS JOIN (SELECT INTSEQ(0, {most}) AS split_id) k)
SELECT CAST(split_id AS INT) AS split_id, train_start, {', '.join(f'{c}.date AS {c}' for c in names)} FROM s {joins} WHERE te + {purge + 2 + val} <= n""")


def walk_forward_over(first: int = 504, purge: int = 63, val: int = 252, test: int = 252, roll: int = 252) -> Template:
    """The splits of walk_forward() on the dates of $panel itself: the first trains on `first` of them."""
    names = {"train_end": "te", "purge_end": f"te + {purge}", "val_start": f"te + {purge + 1}", "val_end": f"te + {purge + 1 + val}",
             "test_start": f"te + {purge + 2 + val}", "test_end": f"least(te + {purge + 2 + val + test}, n)"}
    joins = " ".join(f"JOIN cal {c} ON {c}.i = {e}" for c, e in names.items())
    return Template(f"""
WITH cal AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM $panel) u),
z AS (SELECT max(i) AS n, min(date) AS train_start FROM cal),
s AS (SELECT train_start, n, INTSEQ(0, CAST(greatest(0, floor((n - {first}) / {roll}e0)) AS INT)) AS split_id FROM z),
t AS (SELECT *, {first} + {roll} * split_id AS te FROM s)
SELECT CAST(split_id AS INT) AS split_id, train_start, {', '.join(f'{c}.date AS {c}' for c in names)} FROM t {joins} WHERE te + {purge + 2 + val} <= n""")


ROLE = """CASE WHEN p.date BETWEEN s.train_start AND s.train_end THEN 'train' WHEN p.date BETWEEN s.val_start AND s.val_end THEN 'val'
  WHEN p.date BETWEEN s.test_start AND s.test_end THEN 'test' END"""


def assign() -> Template:
    """(split_id, ticker, date, part) of every panel row in every split: a range join with the few splits."""
    return Template(f"SELECT * FROM (SELECT s.split_id, p.ticker, p.date, {ROLE} AS part FROM $panel p JOIN $splits s ON p.date BETWEEN s.train_start AND s.test_end) a WHERE part IS NOT NULL")


def summary() -> Template:
    return Template(f"""SELECT split_id, part, count(*) AS n_rows, count(DISTINCT ticker) AS n_tickers, count(DISTINCT date) AS n_days, min(date) AS first_day, max(date) AS last_day
FROM ({assign().text}) x GROUP BY split_id, part""")


DATES = "SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM $panel) u"


def purged_kfold(folds: int = 5, purge: int = 63, embargo: int = 21) -> Template:
    """(fold, date, part): contiguous folds of dates, the last with the remainder; dates near the fold train nothing."""
    return Template(f"""
WITH d AS ({DATES}), f AS (SELECT *, fold * floor(n / {folds}) AS s, CASE WHEN fold = {folds - 1} THEN n ELSE (fold + 1) * floor(n / {folds}) END AS e
  FROM d CROSS JOIN (SELECT INTSEQ(0, {folds - 1}) AS fold) k)
SELECT CAST(fold AS INT) AS fold, date, CASE WHEN i >= s AND i < e THEN 'test' ELSE 'train' END AS part FROM f
WHERE (i >= s AND i < e) OR i < s - {purge} OR i > least(n - 1, e + {embargo})""")


def temporal(share: float = 0.7, purge: int = 63) -> Template:
    return Template(f"""WITH d AS ({DATES}) SELECT date, CASE WHEN i <= floor(n * {share}) - 1 THEN 'train' ELSE 'test' END AS part FROM d
WHERE i <= floor(n * {share}) - 1 OR i >= least(floor(n * {share}) + {purge}, n - 1)""")


def _cpcv(groups: int, tests: int, purge: int, embargo: int) -> str:
    combos = list(combinations(range(groups), tests))
    values = ", ".join(f"({c}, {g})" for c, gs in enumerate(combos) for g in gs)
    return f"""
d AS ({DATES}), g AS (SELECT *, least({groups - 1}, floor(i / floor(n / {groups}))) AS grp FROM d),
combo AS (SELECT * FROM (VALUES {values}) v(combo, grp)),
tested AS (SELECT combo, date, i FROM combo JOIN g ON combo.grp = g.grp),
edge AS (SELECT combo, min(i) - {purge} AS lo, max(i) + {embargo} AS hi FROM tested GROUP BY combo),
roles AS (SELECT combo, date, 'test' AS part FROM tested
  UNION ALL SELECT e.combo, g.date, 'train' FROM g JOIN edge e ON g.i < e.lo OR g.i > e.hi)"""


def combinatorial(groups: int = 6, tests: int = 2, purge: int = 63, embargo: int = 21, least: int = 100) -> Template:
    """Per combination of test groups: days of each part; combinations with too few training days are left out."""
    return Template(f"""WITH {_cpcv(groups, tests, purge, embargo)},
c AS (SELECT combo, sum(CASE WHEN part = 'train' THEN 1 ELSE 0 END) AS train_days, sum(CASE WHEN part = 'test' THEN 1 ELSE 0 END) AS test_days FROM roles GROUP BY combo)
SELECT CAST(combo AS INT) AS combo, CAST(train_days AS BIGINT) AS train_days, CAST(test_days AS BIGINT) AS test_days FROM c WHERE train_days >= {least}""")


def roles(groups: int = 6, tests: int = 2, purge: int = 63, embargo: int = 21, least: int = 100) -> Template:
    """(combo, date, part) of each combination of test groups that leaves at least `least` training days."""
    return Template(f"""WITH {_cpcv(groups, tests, purge, embargo)},
ok AS (SELECT combo FROM roles WHERE part = 'train' GROUP BY combo HAVING count(*) >= {least})
SELECT CAST(roles.combo AS INT) AS combo, roles.date, roles.part FROM roles JOIN ok ON roles.combo = ok.combo""")


def holdout(parts: dict[str, float]) -> Template:
    """(date, part): consecutive cuts of the dates by shares, each cut down to whole dates, the last with the rest."""
    whens, done = [], "0"
    for name, share in list(parts.items())[:-1]:
        done = f"{done} + floor(n * {share})"
        whens.append(f"WHEN i < {done} THEN '{name}'")
    return Template(f"WITH d AS ({DATES}) SELECT date, CASE {' '.join(whens)} ELSE '{list(parts)[-1]}' END AS part FROM d")


def evaluate(scored: DataFrame, groups: int = 6, tests: int = 2, purge: int = 63, embargo: int = 21) -> DataFrame:
    """Per combination: rank correlation of signal and forward return over its test rows and the Sharpe ratio (population
    deviation) of sign(signal) * return; the same over all combinations' test rows together, and means over combinations.

    A date is in several combinations, but equal values rank alike in all of them: values are counted by combination and
    ranked over ranges (average_ranks), so no task orders a combination's rows or all of them.
    """
    spark = scored.sparkSession
    known = Template("SELECT date, signal, fwd, sign(signal) * fwd AS pnl FROM $scored WHERE signal IS NOT NULL AND fwd IS NOT NULL").apply(spark, scored=scored)
    tested = Template(f"WITH {_cpcv(groups, tests, purge, embargo)} SELECT CAST(combo AS INT) AS combo, date FROM roles WHERE part = 'test'").apply(spark, panel=scored)
    rows = stored(known.join(tested, "date"), "tested")
    ranked = average_ranks(average_ranks(rows, {"signal": "a", "fwd": "b"}, ["combo"]), {"signal": "c", "fwd": "d"})
    sharpe = f"avg(pnl) / (stddev_pop(pnl) + 1e-10) * {YEAR}"
    return Template(f"""WITH s AS (SELECT combo, count(*) AS n, corr(a, b) AS ic, {sharpe} AS sharpe, grouping(combo) AS every, corr(c, d) AS pooled FROM $ranked GROUP BY GROUPING SETS ((combo), ())),
o AS (SELECT pooled AS pooled_ic, sharpe AS pooled_sharpe FROM s WHERE every = 1)
SELECT combo, n, round(ic, 7) + 0.0 AS ic, round(sharpe, 5) + 0.0 AS sharpe, round(pooled_ic, 7) + 0.0 AS pooled_ic, round(pooled_sharpe, 5) + 0.0 AS pooled_sharpe,
  round(avg(ic) OVER (), 7) + 0.0 AS mean_ic, round(stddev_pop(ic) OVER (), 7) + 0.0 AS std_ic, round(avg(sharpe) OVER (), 5) + 0.0 AS mean_sharpe
FROM s CROSS JOIN o WHERE every = 0""").apply(spark, ranked=stored(ranked.select("combo", "pnl", "a", "b", "c", "d"), "ranked-rows"))
