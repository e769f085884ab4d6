"""Structured Streaming forms of operators (beyond what a batch run needs)."""
