"""Operators for preparing training data: classifiers, near-duplicate joins, sharding, mixing, tokens, media, licences."""
