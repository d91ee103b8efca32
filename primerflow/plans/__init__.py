"""Queries of the engine's operators over the driver's tables, and their SQL."""

from . import checks, modules, more, speech, tables

QUERIES, SQL = {}, {}
for part in (modules, speech, tables, more, checks):
    QUERIES |= part.QUERIES
    SQL |= part.SQL
