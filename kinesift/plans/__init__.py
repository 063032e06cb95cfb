"""Composed jobs: views over the given tables and the end-to-end plans."""
