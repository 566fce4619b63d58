"""The queries of this repository by name, with the DuckDB SQL of each."""

from __future__ import annotations

from . import detection, graphs, learned, scalars

QUERIES: dict = {**graphs.QUERIES, **scalars.QUERIES, **detection.QUERIES, **learned.QUERIES}
ORACLES: dict = {**graphs.ORACLES, **scalars.ORACLES, **detection.ORACLES, **learned.ORACLES}
