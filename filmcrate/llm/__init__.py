"""Operators of a training-data pipeline: scoring, fingerprints, mixing, private data,
quality rules, near-duplicates, archives, token ids and shards. Nothing outside this
subpackage imports it."""
