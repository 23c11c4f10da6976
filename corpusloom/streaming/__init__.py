"""Incremental work: rounds of predictions with state, and the same over streams."""
