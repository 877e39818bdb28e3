"""Catalogue and corpus operators for Spark."""
