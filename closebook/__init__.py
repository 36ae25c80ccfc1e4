"""Reconciliation, exceptions and cash forecasting as Spark jobs."""
