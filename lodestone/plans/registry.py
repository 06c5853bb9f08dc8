"""Named queries and their SQL oracles, gathered by category."""

from __future__ import annotations

from . import chain_entries, chains, dialect_queries, relational, statements

QUERIES: dict = {**relational.QUERIES, **chains.QUERIES, **chain_entries.QUERIES, **dialect_queries.QUERIES, **statements.QUERIES}
ORACLES: dict[str, str] = {**relational.ORACLES, **chains.ORACLES, **chain_entries.ORACLES, **dialect_queries.ORACLES, **statements.ORACLES}
