"""All queries of the engine's own operators."""

from __future__ import annotations

from paperloom.plans import cells, checks, codes, diagnostics, grids, joins, live, pages, reports, runs, trees, web

QUERIES = {k: f for m in (pages, runs, reports, web, trees, grids, joins, diagnostics, cells, codes, checks, live) for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in (pages, runs, reports, web, trees, grids, joins, diagnostics, cells, codes, checks, live) for k, s in m.ORACLES.items()}
