"""Readers of board payloads, feeds and Markdown tables."""
