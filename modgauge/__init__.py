"""Structural-metrics analytics for module dependency graphs, expressed as Spark DataFrame plans."""
