"""Paid-media forecasting as ordinary Spark DataFrame jobs."""
