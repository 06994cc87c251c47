"""Streaming twins of the batch jobs. They run the same column logic on each micro-batch and keep mergeable state."""
