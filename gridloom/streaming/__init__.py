"""Sinks of tiles that come in as a stream."""
