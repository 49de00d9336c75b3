"""Readers, sinks, and the adapter for the driver's tables."""
