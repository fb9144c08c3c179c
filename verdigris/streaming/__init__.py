"""Structured Streaming: incremental ingestion."""
