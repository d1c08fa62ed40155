"""Experiment analytics on Spark."""
