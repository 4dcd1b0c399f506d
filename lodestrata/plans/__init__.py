"""Compositions of operators: ingest, search, consolidation."""
