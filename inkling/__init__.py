"""Approximate and exact feature aggregation for model inference, as Spark jobs."""
