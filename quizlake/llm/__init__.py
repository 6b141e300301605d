"""Operators of a training-data pipeline: search, tokens, language, dedup, packing, archives."""
