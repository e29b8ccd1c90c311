"""All queries of the library by name, and their DuckDB oracles."""

from proofmill.plans import records, scale, texts

QUERIES = records.QUERIES | texts.QUERIES | scale.QUERIES
ORACLES = records.ORACLES | texts.ORACLES | scale.ORACLES
