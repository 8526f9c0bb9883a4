"""The same loads as Structured Streaming queries."""
