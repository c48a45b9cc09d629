"""Registered queries and their SQL."""
