"""Operators for training-data pipelines. Nothing else in loomspark imports this subpackage."""
