"""Structured Streaming: the same operators over streams, with watermarks and state."""
