"""Structured Streaming over crawl events and documents."""
