"""Every registered query of the core engine with its DuckDB counterpart."""

from __future__ import annotations

from sondage.plans import claims, contracts, findings, flows, further, graph, merges, names, obligations, scalars, stores, sweeps, symbols, views
from sondage.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "claims", "contracts", "findings", "flows", "further", "graph", "merges", "names", "obligations", "scalars", "stores", "sweeps", "symbols", "views"]
