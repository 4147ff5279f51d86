"""Operators for building training corpora; nothing else in evispark imports this."""
