"""Part of evispark."""
