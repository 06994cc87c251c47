"""Readers: raw documents, URLs and provider records to typed columns."""
