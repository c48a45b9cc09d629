"""Spark-first analytics over catalogues of recordings, their jobs and exact sample facts."""
