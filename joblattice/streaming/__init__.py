"""Continuous forms: ingest, stall alerts, source lifecycle."""
