"""Structured Streaming: running queries, stateful processors for late data, sessions and keyed state."""
