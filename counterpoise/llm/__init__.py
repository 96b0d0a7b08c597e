"""Operators of a training-data pipeline, each by a method of its own."""
