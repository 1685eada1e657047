"""Operators for training data: near-duplicates, mixing, packing, filters, sharding, language and scoring."""
