"""Bidflow: procurement data pipelines and training-corpus operators on Spark."""
