"""Operators on measurement tables: matching, accounting, verification, comparison, generation."""
