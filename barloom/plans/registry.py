"""All registered queries and their SQL."""

from __future__ import annotations

from barloom.plans import (
    catalog,
    catalog_io,
    catalog_periods,
    catalog_quality,
    oracle,
    oracle_io,
    oracle_periods,
    oracle_quality,
)

QUERIES = {
    **catalog.QUERIES,
    **catalog_periods.QUERIES,
    **catalog_quality.QUERIES,
    **catalog_io.QUERIES,
}

# The SQL modules register into one dictionary when they are imported.
SQL_MODULES = (oracle, oracle_periods, oracle_quality, oracle_io)
ORACLES = oracle.ORACLES
