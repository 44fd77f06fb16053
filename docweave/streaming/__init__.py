"""Streams. The record operators are defined on finite tables; ``decisions`` feeds a decision log as it grows, which goes beyond them."""
