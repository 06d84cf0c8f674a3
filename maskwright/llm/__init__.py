"""Operators for preparing training data: one module each, their registered queries in `queries`."""
