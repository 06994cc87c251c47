"""Operators that work on any table: keyed folds, look-ups, running values and allocations."""
