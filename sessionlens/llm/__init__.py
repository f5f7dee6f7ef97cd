"""Operators for training text: privacy, tokens, quality, packing, duplicates, sharding, fingerprints, language."""
