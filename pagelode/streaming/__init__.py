"""Streaming forms of the log, of windows, and of comparing a result with the one before."""
