"""Spatial-omics analytics as Spark DataFrame operators."""
