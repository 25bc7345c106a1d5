"""Reusable distributed operators: window histories, prefix sums, rank selection."""
