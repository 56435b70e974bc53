"""Sinks: files, metrics in Prometheus' text format, writing each transaction once."""
