"""Table builders and reports: pure DataFrame in, DataFrame out; only ``warehouse`` writes."""
