"""Operators bound to the driver's tables, each beside the SQL that must agree with it."""

from furrow.bindings import fields, models, observations, staging

QUERIES = {**observations.QUERIES, **fields.QUERIES, **staging.QUERIES, **models.QUERIES}
ORACLES = {**observations.ORACLES, **fields.ORACLES, **staging.ORACLES, **models.ORACLES}
