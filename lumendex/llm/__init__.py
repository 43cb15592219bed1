"""Operators of a training-data pipeline. Nothing else in lumendex imports this subpackage."""
