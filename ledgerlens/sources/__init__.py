"""Readers for waves, probe JSON, text logs and tables."""
