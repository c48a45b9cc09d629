"""Column expressions: text, path, timeline, rational and hash functions."""
