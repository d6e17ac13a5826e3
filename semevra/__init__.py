"""Semantic event analytics on Spark: one package, DataFrame-first."""
