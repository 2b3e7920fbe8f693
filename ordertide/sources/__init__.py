"""Readers, adapters, the event generator and sinks."""
