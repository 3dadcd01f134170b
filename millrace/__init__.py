"""Millrace: dataset-integrity, sampling and evaluation analytics as Spark DataFrame operators."""
