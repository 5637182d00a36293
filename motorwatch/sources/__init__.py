"""Readers: every feed arrives as a DataFrame, split and parsed by the executors."""
