"""Composed programs: rendered inputs, registered queries and the ingest pipeline."""
