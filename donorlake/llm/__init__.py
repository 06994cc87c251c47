"""Operators for preparing training text: filters, language and toxicity models, similarity joins, mixing, packing."""
