"""Streaming top-K analytics on order-line events, declared as Spark plans.

Every transformation is a DataFrame function that batch and Structured
Streaming share; the batch form defines what the streaming form must return.
"""
