"""Operators for training-data pipelines: packing, deduplication, fingerprints, scoring, archives,
token coding and sharding. Nothing else in the library imports this subpackage."""
