"""Differentially private, row-aligned releases of Spark tables."""
