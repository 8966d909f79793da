"""Column steps: a feature is a chain of named SQL expressions, each level reading the columns before it.

The same chain runs as Spark projections and renders as plain SQL for a checking engine. All window expressions
of a panel share one partitioning and order, so a chain of any depth costs one exchange and one sort.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


def frame(lo: int | None, hi: int | None, by: str = "ticker", order: str = "date") -> str:
    """OVER clause for rows [lo, hi] relative to the current one; None is unbounded."""

    def edge(n: int | None, far: str) -> str:
        if n is None:
            return f"UNBOUNDED {far}"
        return "CURRENT ROW" if n == 0 else f"{-n} PRECEDING" if n < 0 else f"{n} FOLLOWING"

    return f"OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {edge(lo, 'PRECEDING')} AND {edge(hi, 'FOLLOWING')})"


def last(k: int) -> str:
    """The current row and the k - 1 before it."""
    return frame(-(k - 1), 0)


ORDERED = "OVER (PARTITION BY ticker ORDER BY date)"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) {ORDERED}"


def lead(x: str, k: int = 1) -> str:
    return f"lead({x}, {k}) {ORDERED}"


def rolling(agg: str, x: str, k: int, over: str | None = None, need: int | None = None) -> str:
    """agg over the frame where it holds `need` (k) non-null values, else null."""
    w = over or last(k)
    return f"CASE WHEN count({x}) {w} = {need or k} THEN {agg}({x}) {w} END"


def full_rows(expr: str, k: int) -> str:
    """expr where the frame of k rows is full, whatever is null within it."""
    return f"CASE WHEN count(*) {last(k)} = {k} THEN {expr} END"


def ratio(a: str, b: str) -> str:
    """a / b, null where b is zero."""
    return f"({a}) / nullif({b}, 0)"


@dataclass(frozen=True)
class Steps:
    """levels: {column: expression} in order; out: the columns returned (rounded: column -> digits)."""

    levels: Sequence[Mapping[str, str]]
    out: Sequence[str] = ()
    keys: Sequence[str] = ("ticker", "date")
    digits: Mapping[str, int] = field(default_factory=dict)
    where: str = ""

    @property
    def columns(self) -> list[str]:
        return list(self.out) or list(self.levels[-1])

    def apply(self, panel: DataFrame) -> DataFrame:
        """The panel with the columns of every level; raw, unrounded."""
        for level in self.levels:
            panel = panel.selectExpr("*", *[f"{e} AS {c}" for c, e in level.items()])
        return panel

    def _final(self) -> list[str]:
        return [*self.keys, *[f"round({c}, {self.digits[c]}) + 0.0 AS {c}" if c in self.digits else c for c in self.columns]]

    def result(self, panel: DataFrame) -> DataFrame:
        done = self.apply(panel)
        return (done.where(self.where) if self.where else done).selectExpr(*self._final())

    def sql(self, base: str) -> str:
        """WITH chain over the base query."""
        parts = [f"s0 AS ({base})"]
        for i, level in enumerate(self.levels):
            parts.append(f"s{i + 1} AS (SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in level.items()) + f" FROM s{i})")
        tail = f" WHERE {self.where}" if self.where else ""
        return "WITH " + ",\n".join(parts) + f"\nSELECT {', '.join(self._final())} FROM s{len(self.levels)}{tail}"


def fused(parts: Sequence[Steps]) -> Steps:
    """One chain for several: every column at the first level at which what it reads is there, equal columns once.

    Chains may use a name for different things: the later one's column is renamed unless it is returned, and of two returned
    columns of one name the first stays. However many chains there are, their windows share one exchange and one sort.
    """
    expr: dict[str, str] = {}
    level: dict[str, int] = {}
    out: list[str] = []
    digits: dict[str, int] = {}
    word = re.compile(r"\b[A-Za-z_]\w*\b")
    for i, part in enumerate(parts):
        name: dict[str, str] = {}
        for own in part.levels:
            made = {}
            for c, e in own.items():
                e = word.sub(lambda m: name.get(m[0], m[0]), e)  # noqa: B023
                made[c] = c if expr.get(c, e) == e else f"{c}__{i}"
                if made[c] not in expr:
                    expr[made[c]] = e
                    level[made[c]] = 1 + max((level[r] for r in set(word.findall(e)) if r in level and r != made[c]), default=-1)
            name |= made
        for c in part.columns:
            if c not in out and name.get(c, c) == c:
                out.append(c)
                digits |= {c: part.digits[c]} if c in part.digits else {}
    levels = [{c: expr[c] for c in expr if level[c] == k} for k in range(1 + max(level.values(), default=0))]
    return Steps(levels, out, digits=digits)


def rounded(columns: Sequence[str], n: int = 6) -> dict[str, int]:
    return dict.fromkeys(columns, n)
