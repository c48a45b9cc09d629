"""Relational, dedup, readiness and reconciliation operators."""
