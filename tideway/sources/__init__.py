"""Readers and writers on public Spark sources."""
