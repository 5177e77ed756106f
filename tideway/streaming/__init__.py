"""Structured Streaming form of the telemetry down-sampling."""
