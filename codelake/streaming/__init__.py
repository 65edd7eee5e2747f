"""Incremental runs with Structured Streaming. An addition: the source tool only plans them."""
