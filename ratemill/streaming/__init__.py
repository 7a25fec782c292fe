"""Click events as Structured Streaming jobs."""
