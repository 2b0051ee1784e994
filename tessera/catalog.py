"""Registry of the engine's own queries and their DuckDB equivalents."""

from __future__ import annotations

from tessera.plans import changes, documents, files, graphs, hotspots, maps, reviews, sources, upkeep

MODULES = (hotspots, graphs, files, changes, documents, upkeep, sources, reviews, maps)

QUERIES = {name: f for module in MODULES for name, f in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
