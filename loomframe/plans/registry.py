"""All registered queries of the panel engine with their DuckDB oracles."""

from __future__ import annotations

from . import flows, panel, prepare, research

MODULES = (panel, prepare, research, flows)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLES.items()}
