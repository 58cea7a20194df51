"""Queries over the driver's tables, each with the SQL that must give the same rows."""

from sheetwright.queries import documents, extras, formulas, layout

QUERIES = {**formulas.QUERIES, **documents.QUERIES, **layout.QUERIES, **extras.QUERIES}
ORACLES = {**formulas.ORACLES, **documents.ORACLES, **layout.ORACLES, **extras.ORACLES}
