"""Operators over notes: parsing, search, reports, maintenance, rewriting and ingest."""
