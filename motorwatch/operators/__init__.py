"""Distributed building blocks: merge, diff, quantiles, samples, chunks, vector search, sessions."""
