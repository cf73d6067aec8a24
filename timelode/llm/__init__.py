"""Operators for large-scale training-data pipelines. Nothing else in timelode imports this subpackage."""
