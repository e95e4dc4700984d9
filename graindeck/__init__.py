"""Retrieval, dataset-quality and experiment analytics as Spark DataFrame operators."""
