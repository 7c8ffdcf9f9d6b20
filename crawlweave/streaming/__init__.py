"""Structured Streaming forms of the crawl's state."""
