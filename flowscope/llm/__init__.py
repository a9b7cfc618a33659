"""Operators of a training-data pipeline: extraction, search, encoding, filtering, sharding."""
