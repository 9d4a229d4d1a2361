"""The same joins as Structured Streaming queries."""
