"""Contribution analytics as Spark jobs: every job is a plain ``DataFrame -> DataFrame`` function."""
