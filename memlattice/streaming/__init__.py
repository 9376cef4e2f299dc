"""Structured Streaming forms of the journal, event and progress operators."""
