"""Exact local-alignment search over sequence collections, planned by Spark."""
