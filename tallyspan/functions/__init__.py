"""Column functions: ranges, identities, validators, statistics."""
