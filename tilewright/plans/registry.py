"""All queries of the tile engine and their DuckDB SQL."""

from __future__ import annotations

from tilewright.plans import pixels, runs, scans, selection

QUERIES = {**selection.QUERIES, **pixels.QUERIES, **runs.QUERIES, **scans.QUERIES}
ORACLES = {**selection.ORACLES, **pixels.ORACLES, **runs.ORACLES, **scans.ORACLES}
