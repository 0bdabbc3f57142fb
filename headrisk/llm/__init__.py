"""Operators for preparing training data: one module each, with their queries in `queries`."""
