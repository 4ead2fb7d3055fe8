"""Operators for large text and vector corpora. Nothing else in the package imports this one."""
