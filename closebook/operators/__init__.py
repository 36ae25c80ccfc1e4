"""Joins, aggregations and cascades over canonical transactions."""
