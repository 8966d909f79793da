"""Queries over the derived panel whose operators are chains of column steps."""

from __future__ import annotations

from loomframe.functions.sqlsteps import Steps
from loomframe.operators import informed, microstructure, technical
from loomframe.sources.bars import BARS_SQL, bars

from . import oracles

FAMILIES = {**technical.FAMILIES, "t20_all": technical.compute_all, **microstructure.FAMILIES, **informed.FAMILIES}


def query(steps: Steps):
    return lambda spark, sf_dir: steps.result(bars(spark, sf_dir))


QUERIES = {name: query(f()) for name, f in FAMILIES.items()}
ORACLES = {name: f().sql(BARS_SQL) for name, f in FAMILIES.items()} | oracles.TECHNICAL | oracles.MICRO | oracles.INFORMED | {k: v for k, v in oracles.flow().items() if k in FAMILIES}
QUERIES["entry_realized_vol"], ORACLES["entry_realized_vol"] = QUERIES["t05_realized_vol"], ORACLES["t05_realized_vol"]
