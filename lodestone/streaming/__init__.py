"""Micro-batch writes of streams into versioned tables."""
