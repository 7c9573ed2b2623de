"""The same operators on Structured Streaming."""
