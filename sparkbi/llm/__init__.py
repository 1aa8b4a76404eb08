"""Operators for preparing text corpora: fingerprints, packing, sharding, language, extraction, mixing, scoring, counting."""
