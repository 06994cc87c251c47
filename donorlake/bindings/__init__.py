"""Donation inputs made of the given tables, the queries over them, and the SQL they are checked against."""
