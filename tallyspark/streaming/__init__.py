"""Structured Streaming operators and the batch twins that check them."""
