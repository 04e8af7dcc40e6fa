"""Bars and indicators by Structured Streaming."""
