"""Structured Streaming forms of the operators that need no global order."""
