"""Streaming ingestion of statements (an extension of the batch operators)."""
