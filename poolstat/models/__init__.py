"""Fits and tests on sufficient statistics that Spark aggregates."""
