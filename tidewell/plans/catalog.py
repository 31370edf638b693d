"""The registered queries, and the SQL each is compared with."""

from __future__ import annotations

from . import detection, exchange, ingest, models, relational, routines, site, timeseries

QUERIES: dict = relational.QUERIES | timeseries.QUERIES | detection.QUERIES | exchange.QUERIES | ingest.QUERIES | site.QUERIES | models.QUERIES | routines.QUERIES
SQL: dict[str, str] = relational.SQL | timeseries.SQL | detection.SQL | exchange.SQL | ingest.SQL | site.SQL | models.SQL | routines.SQL
