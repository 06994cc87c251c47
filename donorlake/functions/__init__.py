"""Column expressions. Nothing here starts a job: each function maps columns to a column."""
