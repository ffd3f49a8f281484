"""Continuous runs: micro-batches over versioned state."""
