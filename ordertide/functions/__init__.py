"""Scalar helpers over Spark columns and request parameters."""
