"""Deferred-formatting log streams on Spark."""
