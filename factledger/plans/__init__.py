"""Queries over the given tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from factledger.plans import attacks, corpora, evaluation, factory, grounding, ingest, judging, ledger, lookups, planned, records, review, scoring, structure

QUERIES = ledger.QUERIES | ingest.QUERIES | factory.QUERIES | evaluation.QUERIES | scoring.QUERIES | grounding.QUERIES | records.QUERIES | review.QUERIES | structure.QUERIES | lookups.QUERIES | attacks.QUERIES | judging.QUERIES | planned.QUERIES | corpora.QUERIES
ORACLES = ledger.ORACLES | ingest.ORACLES | factory.ORACLES | evaluation.ORACLES | scoring.ORACLES | grounding.ORACLES | records.ORACLES | review.ORACLES | structure.ORACLES | lookups.ORACLES | attacks.ORACLES | judging.ORACLES | planned.ORACLES | corpora.ORACLES
