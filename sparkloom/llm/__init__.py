"""Operators for large training-data pipelines: deduplication, tokenisation, sharding, decontamination and filtering."""
