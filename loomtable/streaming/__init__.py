"""Structured Streaming: continuous catch-up from a change log."""
