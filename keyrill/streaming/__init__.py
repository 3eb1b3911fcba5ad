"""The same semantics on Structured Streaming."""
