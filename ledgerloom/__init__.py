"""Accounting analytics on Spark."""
